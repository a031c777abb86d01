"""Quality classifier from weak labels (operator 5).

Overlapping heuristics vote good, poor or nothing on each text. Expectation-
maximisation over counts of vote patterns estimates how often each votes what on
good and on poor texts; the posterior of a text's pattern is its label. A linear
scorer over hashed words, word shapes and shares learns these labels.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, fresh, sampled, values
from textloom.llm.statistics import share, text_statistics

#: Buckets of hashed features, and most texts that the scorer is fitted on.
BUCKETS, SAMPLE_ROWS = 1 << 14, 10_000
#: A text is kept from this score on.
LEAST_SCORE = 0.5
#: Words whose features a worker remembers.
CACHE_WORDS = 500_000

POOR, GOOD, SILENT = 0, 1, 2

_FEATURES = pa.schema(
    [
        ("crc", pa.int64()),
        ("pattern", pa.int64()),
        ("i", pa.string()),
        ("place", pa.binary()),  # unsigned 16-bit integers
        ("value", pa.binary()),  # 32-bit floats
    ]
)

#: Labellers: measure, poor if above, good if at most; or the other way round with a minus sign.
LABELLERS = {
    "symbols": ("symbol_share", 0.02, 0.002),
    "repeats": ("repeat_share", 0.5, 0.1),
    "capitals": ("upper_share", 0.3, 0.1),
    "few_words": ("-distinct_share", 0.2, 0.45),
    "same_lines": ("dup_line_share", 0.3, 0.1),
    "marks": ("mark_share", 0.1, 0.02),
    "bars": ("bar_share", 0.2, 0.02),
    "long_words": ("word_length", 9.0, 6.5),
    "short_words": ("-word_length", 2.5, 3.5),
}


def votes(stats: str) -> dict[str, Column]:
    """A vote of each labeller on a statistics column; a text without words is poor for all."""
    out = {}
    for name, (measure, poor, good) in LABELLERS.items():
        sign = -1 if measure[0] == "-" else 1
        x = sign * share(stats, measure.lstrip("-"))
        vote = F.when(x > sign * poor, POOR).when(x <= sign * good, GOOD).otherwise(SILENT)
        out[name] = F.when(F.col(f"{stats}.n_words") == 0, POOR).otherwise(vote)
    return out


def pattern(stats: str) -> Column:
    """All votes of a text as one number."""
    out = F.lit(0)
    for vote in votes(stats).values():
        out = out * 3 + vote
    return out.cast("int")


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Votes by pattern and labeller."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // powers % 3


@dataclass
class Accuracies:
    """Share of good texts, and of votes by labeller, kind of text (poor, good) and vote."""

    prior: float
    of_votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """How likely texts with these votes are good."""
        each = unpacked(patterns)
        logs = np.log(self.of_votes)
        at = np.arange(each.shape[1])
        poor, good = (logs[at, kind, each].sum(axis=1) for kind in (POOR, GOOD))
        odds = good - poor + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Accuracies:
    """Expectation-maximisation from the majority of votes; smoothed, so no vote is impossible."""
    each = unpacked(patterns)
    said_poor, said_good = (each == POOR).sum(axis=1), (each == GOOD).sum(axis=1)
    # A vote against is rarer and says more than one in favour.
    good = np.where(said_poor > 0, 0.5 ** (2 * said_poor), np.where(said_good > 0, 0.95, 0.5))
    model = None
    for _ in range(rounds):
        prior = (good @ counts + 1) / (counts.sum() + 2)
        of_votes = np.zeros((each.shape[1], 2, 3))
        for kind, weight in ((POOR, counts * (1 - good)), (GOOD, counts * good)):
            for vote in range(3):
                of_votes[:, kind, vote] = weight @ (each == vote) + 1
        of_votes /= of_votes.sum(axis=2, keepdims=True)
        model = Accuracies(float(prior), of_votes)
        now = model.posterior(patterns)
        if np.abs(now - good).max(initial=0) < 1e-9:
            break
        good = now
    return model


def _shape(word: bytes) -> bytes:
    """Runs of capitals, letters, digits and of each other sign, one character each."""
    out = bytearray()
    for c in word:
        if 65 <= c <= 90:
            c = 88
        elif 97 <= c <= 122 or c >= 128:
            c = 120
        elif 48 <= c <= 57:
            c = 57
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out[:12])


class _Buckets(dict):
    """Buckets of a word and of its shape, remembered for words seen often."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        got = (crc32(b"w" + word.lower()) % BUCKETS, crc32(b"s" + _shape(word)) % BUCKETS)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = got
        return got


@lru_cache(maxsize=1)
def buckets() -> _Buckets:
    return _Buckets()


def features(text: bytes, known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their values: roots of the shares of words, shapes and repeated neighbours."""
    words = text.split()
    if not words:
        return np.array([crc32(b"empty") % BUCKETS]), np.ones(1)
    pairs = np.array(list(map(known.__getitem__, words)), np.int64)
    named = np.concatenate([pairs[:, 0], pairs[:, 1]])
    again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    few = len(set(words)) / len(words)
    place, counts = np.unique(named, return_counts=True)
    extra = [crc32(b"again") % BUCKETS, crc32(b"few") % BUCKETS, crc32(b"bias") % BUCKETS]
    return (
        np.concatenate([place, extra]),
        np.concatenate([np.sqrt(counts / len(words)), [again * 4, (1 - few) * 4, 1.0]]),
    )


@dataclass
class Scorer:
    weights: np.ndarray

    def score(self, text: bytes) -> float:
        place, value = features(text, buckets())
        return float(1 / (1 + np.exp(-np.clip(self.weights[place] @ value, -500, 500))))


def train(
    made: list[tuple[np.ndarray, np.ndarray]],
    good: np.ndarray,
    rounds: int = 8,
    rate: float = 0.5,
    seed: int = 7,
) -> Scorer:
    """Logistic regression on soft labels by adaptive gradient steps, both kinds weighing alike."""
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    if not made:
        return Scorer(weights)
    share_good = float(np.clip(good.mean(), 0.02, 0.98))
    weight = good * 0.5 / share_good + (1 - good) * 0.5 / (1 - share_good)
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(made)):
            place, value = made[k]
            p = 1 / (1 + np.exp(-np.clip(weights[place] @ value, -500, 500)))
            step = weight[k] * (p - good[k]) * value + 1e-6 * weights[place]
            squares[place] += step * step
            weights[place] -= rate * step / np.sqrt(squares[place])
    return Scorer(weights)


@dataclass
class Model:
    accuracies: Accuracies
    scorer: Scorer
    posteriors: dict[int, float]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Accuracies from the votes on all texts; the scorer from at most about ``sample_rows`` of them.

    The sample is of distinct pairs of id and text.

    What comes to the driver is a count for each pattern of votes, at most
    3 ** labellers, and for each text of the sample at most six bytes for each of
    BUCKETS features. An empty table gives a model that scores 0.5.
    """
    stats, own = fresh(docs, "statistics"), fresh(docs, "pattern")
    voted = docs.withColumn(stats, text_statistics(text_col)).withColumn(own, pattern(stats))
    counted = voted.groupBy(own).count().collect()
    if not counted:
        return Model(Accuracies(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), train([], np.zeros(0)), {})
    patterns = np.array([r[0] for r in counted], np.int64)
    counts = np.array([r[1] for r in counted], float)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    accuracies = estimate(patterns, counts)
    posteriors = dict(zip(patterns.tolist(), accuracies.posterior(patterns).tolist(), strict=True))
    pairs = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    # By id and text, and repeated rows once, so that rows that share an id, or have none, keep to the bound.
    chosen = sampled(pairs, F.struct("i", "t"), sample_rows).dropDuplicates()

    # Texts become features on the executors; the driver gets some numbers of each.
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = buckets()
        for b in batches:
            for k, text in enumerate(values(b.column(1))):
                made = {"crc": crc32(text), "pattern": b.column(2)[k].as_py(), "i": b.column(0)[k].as_py()}
                place, value = features(text, known)
                made |= {"place": place.astype("<u2").tobytes(), "value": value.astype("<f4").tobytes()}
                yield pa.RecordBatch.from_pylist([made], _FEATURES)

    rows = chosen.withColumn("_s", text_statistics("t")).select(
        F.col("i").cast("string").alias("i"), as_bytes("t").alias("t"), pattern("_s").cast("long").alias("p")
    )
    got = rows.mapInArrow(featured, "crc long, pattern long, i string, place binary, value binary")
    held = sorted(got.collect(), key=lambda r: (r["i"] or "", r["crc"]))
    made = [(np.frombuffer(r["place"], "<u2"), np.frombuffer(r["value"], "<f4")) for r in held]
    good = np.array([posteriors.get(r["pattern"], 0.5) for r in held])
    return Model(accuracies, train(made, good), posteriors)


def score(text: str | Column, model: Model) -> Column:
    scorer = model.scorer

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t) for t in values(texts)], pa.float64())

    return F.arrow_udf(run, "double")(as_bytes(text))


def judge(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too: posterior, score, kept.

    All rows stay. A null or empty text has votes against it only and is not kept.
    """
    stats, own, out = (fresh(docs, n) for n in ("statistics", "score", "judged"))
    found = docs.withColumn(stats, text_statistics(text_col)).withColumn(own, score(text_col, model))
    posterior = F.lit(None).cast("double")
    known = F.create_map(*(F.lit(x) for pair in model.posteriors.items() for x in pair)) if model.posteriors else None
    if known is not None:
        posterior = known[pattern(stats)]
    words = F.col(f"{stats}.n_words") > 0
    fields = [posterior.alias("posterior"), F.col(own).alias("score"), (words & (F.col(own) >= least)).alias("kept")]
    return found.withColumn(out, F.struct(*fields)).drop(stats, own), out
