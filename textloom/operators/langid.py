"""Language identification by naive Bayes over character 1- to 3-grams.

Grams are made of whole texts at a time, as arrays of numbers, and each task adds
up its own before anything is shuffled.  A learned profile that is proven small
goes to the texts, which then stay where they are; beyond that the grams of
distinct words meet the profile in joins.  Either way a language is a place in an array or a row, never a column, so plans
are as wide for thousands of languages as for two.  Log-probabilities are held as
whole millionths, so sums come out the same in whatever order Spark adds them.

Of the scores a posterior is made, with a temperature fitted on texts that were
not learned from: grams of one text are not independent, and without it nearly
every text would be called certain.
"""

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textloom import fixed
from textloom.operators.lookup import BROADCAST_ROWS, lookup_join, reference_table
from textloom.session import written

SCALE = 1_000_000
PIECE = 256
PROFILE_ROWS = 2_000_000
#: Most gains (grams times languages) of a profile that goes to the texts.
PROFILE_GAINS = 4_000_000
#: Characters looked at together, and distinct grams that a task counts before it passes them on.
RUN, HELD = 1 << 20, 1 << 20
#: Temperatures tried: millionths of a log-probability that count as one.
TEMPERATURES = tuple(SCALE * 2**k for k in range(13))


def words(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """One row per word: lower-cased runs of letters, separated by everything else."""
    found = F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("_word")
    return df.select(*keep, found).where(F.col("_word") != "")


def grams(found: DataFrame) -> DataFrame:
    """Three rows per letter of ``_word``: itself, with the one after it, and with both neighbours.

    A blank stands before and after each word.  Finding a place in a string
    takes longer the further in it lies, so words without end, such as
    letters run together by accident, are looked at in overlapping pieces.
    """
    names = found.columns
    padded = F.concat(F.lit(" "), F.col("_word"), F.lit(" "))
    cut = F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}")
    pieces = F.when(F.length("_word") <= PIECE, F.array(padded)).otherwise(
        F.regexp_extract_all(padded, cut, F.lit(1))
    )
    letters = found.select(*names, F.explode(pieces).alias("_piece")).where(F.length("_piece") > 2)
    places = F.explode(F.sequence(F.lit(1), F.length("_piece") - 2)).alias("_i")
    i = F.col("_i")
    at_letter = F.array(
        F.substring("_piece", i + 1, F.lit(1)),
        F.substring("_piece", i + 1, F.lit(2)),
        F.substring("_piece", i, F.lit(3)),
    )
    return letters.select(*names, "_piece", places).select(
        *names, F.explode(at_letter).alias("gram")
    )


def _letters(text: Column) -> Column:
    """A text's words as ``words`` finds them, with a blank before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def _keys(letters: str) -> Iterator[np.ndarray]:
    """The grams that ``grams`` makes, of each run of a text, as numbers: 21 bits a character."""
    codes = np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.int64)
    for start in range(1, len(codes) - 1, RUN):
        inside = slice(start, min(start + RUN, len(codes) - 1))
        at = np.flatnonzero(codes[inside] != 32) + start
        one = codes[at] << 21
        two = one | codes[at + 1]
        yield np.concatenate([one, two, two | codes[at - 1] << 42])


def _gram(key: int) -> str:
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


def _key(gram: str) -> int:
    codes = [ord(c) for c in gram]
    if len(codes) == 3:
        return codes[0] << 42 | codes[1] << 21 | codes[2]
    return codes[0] << 21 | (codes[1] if len(codes) == 2 else 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of rows (lang, letters): what a task has seen."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def merged() -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for lang, parts in held.items():
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            found, place = np.unique(keys, return_inverse=True)
            out[lang] = found, np.bincount(place, counts).astype(np.int64)
        return out

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, (keys, counts) in merged().items():
            columns = [pa.array([lang] * len(keys), pa.string()), pa.array(map(_gram, keys.tolist()), pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], ["lang", "gram", "n"])

    for batch in batches:
        for lang, letters in zip(batch.column(0).to_pylist(), batch.column(1)):
            for keys in _keys(letters.as_py() or ""):
                held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                size += len(held[lang][-1][0])
            if size > HELD:
                held = {k: [v] for k, v in merged().items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from flushed()
                    held, size = {}, 0
    yield from flushed()


@dataclass
class LanguageProfile:
    """What a gram adds in a language that has it: table (gram, lang, gain) over ``unseen``.

    ``languages`` are in order; ``unseen`` is the log-probability of a gram that a
    language has never shown; ``grams`` is how many distinct ones there are.
    """

    languages: list[str]
    table: DataFrame
    unseen: list[int]
    grams: int


def fit(
    df: DataFrame, text: str = "text", lang: str = "lang", languages: Sequence[str] | None = None
) -> LanguageProfile:
    """Count grams per language over all labelled texts of ``df`` and take logarithms."""
    labelled = df.where(F.col(lang).isNotNull())
    if languages is not None:
        labelled = labelled.where(F.col(lang).isin(list(languages)))
    seen = labelled.select(F.col(lang).cast("string"), _letters(F.col(text)))
    counted = seen.mapInArrow(_counted, "lang string, gram string, n long")
    counted = written(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    size = counted.select("gram").distinct().count()
    sums = dict(counted.groupBy("lang").agg(F.sum("n")).collect())  # a row per language
    found = sorted(sums if languages is None else languages)
    totals = {code: float(sums.get(code, 0) + size) for code in found if sums.get(code, 0) + size}
    # Log-probability of a gram that a language has never shown
    unseen = {code: round(math.log(1.0 / total) * SCALE) for code, total in totals.items()}
    known = [(code, totals[code], unseen[code]) for code in totals]
    known = _of_languages(df, known, {"lang": "string", "total": "float64", "none": "int64"})
    share = (F.col("n") + 1).cast("double") / F.col("total")
    gain = F.round(F.log(share) * F.lit(float(SCALE))).cast("bigint") - F.col("none")
    table = counted.join(known, "lang").select("gram", "lang", gain.alias("gain"))
    return LanguageProfile(found, table, [unseen.get(code, 0) for code in found], size)


def _of_languages(df: DataFrame, rows: Sequence[tuple], schema: dict[str, str]) -> DataFrame:
    """A table with a row per language, marked for broadcast if there are not very many."""
    table = reference_table(df.sparkSession, rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _parts(df: DataFrame, profile: LanguageProfile, id_: str, text: str) -> DataFrame:
    """(id, place, s): parts of each text's score in each language, to be added up; a small profile."""
    places = _of_languages(df, list(enumerate(profile.languages)), {"_place": "int32", "lang": "string"})
    learned = profile.table.join(places, "lang")
    rows = learned.select("gram", "_place", "gain").toArrow()
    grams_ = rows.column("gram").combine_chunks().dictionary_encode()
    keys = np.array([_key(g) for g in grams_.dictionary.to_pylist()], np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], len(profile.languages)
    # The last row is that of grams which no language has.
    gains = np.zeros((len(keys) + 1, n), np.int64)
    row = np.argsort(order)[grams_.indices.to_numpy()]
    gains[row, rows.column("_place").to_numpy()] = rows.column("gain").to_numpy()
    unseen = np.array(profile.unseen, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sums = [], []
            for k, letters in enumerate(batch.column(1)):
                total, size = np.zeros(n, np.int64), 0
                for own in _keys(letters.as_py() or ""):
                    place = np.searchsorted(keys, own)
                    known = keys[np.minimum(place, len(keys) - 1)] == own
                    counts = np.bincount(np.where(known, place, len(keys)), minlength=len(gains))
                    some = np.flatnonzero(counts)
                    total += counts[some] @ gains[some]
                    size += len(own)
                if size:
                    at.append(k)
                    sums.append(total + size * unseen)
            if at:
                ids = batch.column(0).take(pa.array(np.repeat(at, n)))
                place = pa.array(np.tile(np.arange(n, dtype=np.int32), len(at)))
                yield pa.RecordBatch.from_arrays([ids, place, pa.array(np.concatenate(sums))], ["i", "p", "s"])

    kind = df.schema[id_].dataType.simpleString()
    read = df.select(id_, _letters(F.col(text)))
    return read.mapInArrow(run, f"_id {kind}, _place int, s long")


def _joined_parts(df: DataFrame, profile: LanguageProfile, id_: str, text: str) -> DataFrame:
    """As ``_parts`` for profiles of any size: grams of distinct words look their gains up."""
    times = F.count(F.lit(1)).alias("_times")
    by_text = words(df, F.col(text), F.col(id_).alias("_id")).groupBy("_id", "_word").agg(times)
    by_text = written(by_text, "text-words")
    rows = list(zip(range(len(profile.languages)), profile.languages, profile.unseen))
    codes = _of_languages(df, rows, {"_place": "int32", "lang": "string", "unseen": "int64"})
    learned = profile.table.join(codes, "lang")
    gains = learned.groupBy("gram").agg(F.collect_list(F.struct("_place", "gain")).alias("gains"))
    each = grams(by_text.select("_word").distinct())
    known = lookup_join(each, written(gains, "gram-gains"), ["gram"], max_rows=PROFILE_ROWS)
    by_word = known.select("_word", F.explode("gains").alias("g")).groupBy("_word", "g._place")
    by_word = by_word.agg(F.sum("g.gain").alias("s"))
    by_word = by_word.groupBy("_word").agg(F.collect_list(F.struct("_place", "s")).alias("own"))
    # Hot words are dealt out by the lookup.
    placed = lookup_join(by_text, written(by_word, "word-scores"), ["_word"])
    parts = placed.select("_id", "_times", F.explode("own").alias("o"))
    parts = parts.select("_id", "o._place", (F.col("_times") * F.col("o.s")).alias("s"))
    # Three grams per letter
    totals = by_text.groupBy("_id").agg(F.sum(F.col("_times") * F.length("_word") * 3).alias("_total"))
    every = F.explode(F.sequence(F.lit(0), F.lit(len(profile.languages) - 1))).alias("_place")
    none = totals.select("_id", every, "_total").join(codes, "_place")
    none = none.select("_id", "_place", (F.col("_total") * F.col("unseen")).cast("bigint").alias("s"))
    return parts.unionByName(none)


def scores(df: DataFrame, profile: LanguageProfile, id_: str, text: str = "text") -> DataFrame:
    """(id, scores) of each text that has letters: its log-probability and place of each language, best first.

    Of equals the first language comes first.  Texts of one id count as one text.
    """
    fits = profile.grams * len(profile.languages) <= PROFILE_GAINS
    parts = (_parts if fits else _joined_parts)(df, profile, id_, text)
    sums = parts.groupBy("_id", "_place").agg(F.sum("s").alias("s"))
    each = F.collect_list(F.struct("s", (-F.col("_place")).alias("place")))
    return sums.groupBy(F.col("_id").alias(id_)).agg(F.sort_array(each, asc=False).alias("scores"))


def posterior(all_scores: Column, temperature: float) -> Column:
    """Probability of the best language among all, by log-sum-exp of its distance to the others."""
    best = all_scores[0]["s"]
    far = F.transform(all_scores, lambda x: F.exp((x["s"] - best).cast("double") / F.lit(float(temperature))))
    return F.lit(1.0) / F.aggregate(far, F.lit(0.0), lambda a, b: a + b)


def fit_temperature(
    df: DataFrame,
    profile: LanguageProfile,
    id_: str,
    text: str = "text",
    lang: str = "lang",
    temperatures: Sequence[float] = TEMPERATURES,
) -> float:
    """The temperature under which the true languages of ``df`` are most probable.

    ``df`` must not be what ``profile`` was learned from.  Texts without letters
    and of languages that the profile does not know say nothing; without any
    others, the smallest temperature.
    """
    if not profile.languages:
        return float(temperatures[0])
    rows = [(-k, code) for k, code in enumerate(profile.languages)]
    places = _of_languages(df, rows, {"place": "int32", "_true": "string"})
    known = scores(df, profile, id_, text).join(df.select(id_, F.col(lang).alias("_true")), id_)
    known = known.join(places, "_true")
    own = F.filter("scores", lambda x: x["place"] == F.col("place"))[0]["s"]
    loss = [
        F.sum(
            -F.log(posterior(F.col("scores"), t))
            - (own - F.col("scores")[0]["s"]).cast("double") / F.lit(float(t))
        ).alias(f"t{k}")
        for k, t in enumerate(temperatures)
    ]
    row = known.agg(*loss).first()
    return float(min(zip((x if x is not None else 0.0 for x in row), temperatures))[1])


def detect(
    df: DataFrame,
    profile: LanguageProfile,
    id_: str,
    text: str = "text",
    temperature: float | None = None,
) -> DataFrame:
    """``df`` without its text, with ``detected`` and ``log_score``; unknown for texts without any letter.

    With a ``temperature`` also ``probability``, that of the detected language; 0
    where it is unknown.  The text itself is not shuffled; join by id where it is wanted.
    """
    rest = df.drop(text)
    unknown = F.lit(fixed.UNKNOWN_LANGUAGE)
    if not profile.languages:
        out = rest.withColumn("detected", unknown).withColumn("log_score", F.lit(None).cast("bigint"))
        return out if temperature is None else out.withColumn("probability", F.lit(0.0))
    found = scores(df, profile, id_, text)
    best = F.col("scores")[0]
    kept = [id_, best["s"].alias("log_score"), (-best["place"]).alias("_place")]
    if temperature is not None:
        kept.append(posterior(F.col("scores"), temperature).alias("probability"))
    found = found.select(*kept)
    names = _of_languages(df, list(enumerate(profile.languages)), {"_place": "int32", "detected": "string"})
    found = found.join(names, "_place").drop("_place")
    joined = rest.join(found, id_, "left")
    joined = joined.withColumn("detected", F.coalesce(F.col("detected"), unknown))
    if temperature is not None:
        joined = joined.withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    names_ = [*rest.columns, "detected", "log_score"] + (["probability"] if temperature is not None else [])
    return joined.select(*names_)
