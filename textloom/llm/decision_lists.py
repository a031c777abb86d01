"""Quality rules learned as decision lists (operator 10).

Sequential covering: grow a conjunction of threshold conditions on part of the
labelled rows, prune it on the others, keep it if it is precise there, drop the
rows it covers, and go on. The list comes out as ordered Spark conditions.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, sampled
from textloom.llm.statistics import measures, text_statistics

#: Most labelled documents that a list is learned from.
SAMPLE_ROWS = 20_000
#: Base rules: fewest words, and percent of words that may lie in repeated windows.
LEAST_WORDS = 50
REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.measure]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class Rule:
    """Rejects what meets all conditions; the figures are those of the pruning rows."""

    conditions: list[Condition] = field(default_factory=list)
    precision: float = 0.0
    covered: int = 0

    def holds(self, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for c in self.conditions:
            out &= c.holds(rows)
        return out

    def column(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            x = columns[c.measure]
            out = out & (x > c.threshold if c.above else x <= c.threshold)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) or "always"


def _cuts(x: np.ndarray, most: int = 64) -> np.ndarray:
    """Thresholds halfway between neighbouring values, about evenly many rows apart."""
    own = np.unique(x)
    if len(own) > most:
        own = np.unique(np.quantile(x, np.linspace(0, 1, most)))
    return (own[:-1] + own[1:]) / 2


def _grow(rows: dict, bad: np.ndarray, longest: int) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule, covered = Rule(), np.ones(len(bad), bool)
    while len(rule.conditions) < longest and (covered & ~bad).any():
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        before = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for name, x in rows.items():
            held, held_bad = x[covered], bad[covered]
            cuts = _cuts(held)
            if not len(cuts):
                continue
            order = np.argsort(held, kind="stable")
            up_to = np.searchsorted(held[order], cuts, side="right")
            bads = np.concatenate([[0], np.cumsum(held_bad[order])])[up_to]
            for above in (False, True):
                pos = p - bads if above else bads
                neg = (len(held) - up_to if above else up_to) - pos
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), 0)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), gains[k]
        if best is None:
            break
        rule.conditions.append(best)
        covered &= best.holds(rows)
    return rule


def _prune(rule: Rule, rows: dict, bad: np.ndarray) -> Rule:
    """The leading conditions that do best on rows the rule was not grown on."""
    best = Rule()
    worth = -np.inf
    for k in range(len(rule.conditions), 0, -1):
        cut = Rule(rule.conditions[:k])
        held = cut.holds(rows, len(bad))
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth:
            worth = (p - n) / (p + n)
            best = Rule(cut.conditions, p / (p + n), p + n)
    return best


def learn(
    rows: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.95,
    least_covered: int = 3,
    longest: int = 4,
    most_rules: int = 24,
    seed: int = 7,
) -> list[Rule]:
    """An ordered list of rejecting rules; empty where nothing can be told from the rows."""
    if not len(bad) or not bad.any() or bad.all():
        return []
    rules: list[Rule] = []
    draw = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    misses = 0
    while len(rules) < most_rules and misses < 3 and (left & bad).any():
        growing = draw.random(len(bad)) < 2 / 3
        on, off = left & growing, left & ~growing
        if not (on & bad).any() or not (on & ~bad).any():
            break
        rule = _grow({k: x[on] for k, x in rows.items()}, bad[on], longest)
        rule = _prune(rule, {k: x[off] for k, x in rows.items()}, bad[off])
        if not rule.conditions or rule.precision < precision or rule.covered < least_covered:
            misses += 1  # another split may show a better rule
            continue
        rules.append(rule)
        left &= ~rule.holds(rows, len(bad))
    return rules


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """Learn from documents labelled 0 (reject) or 1, at most about ``sample_rows`` of them.

    Labels that are null are left out; a document labelled both ways counts as
    0; of repeated rows of a labelled document one is used. Documents that the
    base rules reject teach nothing, as the list never sees them. No labels:
    an empty list, which rejects nothing.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
        .dropna()
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
    )
    # The sample's size is bounded by sample_rows, so it may be broadcast.
    chosen = F.broadcast(sampled(known, F.col("_id"), sample_rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stats = (
        texts.join(chosen, "_id")
        .select("_id", "_label", text_statistics("_text").alias("_stats"))
        .groupBy("_id", "_label")
        .agg(F.min("_stats").alias("_stats"))
        .filter(~base_failed("_stats"))
    )
    columns = measures("_stats")
    found = stats.select("_id", "_label", *(c.alias(k) for k, c in columns.items())).toPandas()
    found = found.sort_values("_id")  # the same order, and so the same list, at each run
    return learn({k: found[k].to_numpy(float) for k in columns}, found["_label"].to_numpy() == 0)


def base_failed(stats: str) -> Column:
    words, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * words)


def verdict(rules: list[Rule], stats: str) -> Column:
    """Number of the first rule that rejects a row; null where none does."""
    columns = measures(stats)
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(columns), F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct whose name is returned too.

    Its fields: ``stats``; ``base_failed``; ``rule``, the number of the first
    learned rule that rejects; ``kept``. All rows stay. A null or empty text has
    no words and fails the base rules.
    """
    stats, out = fresh(docs, "statistics"), fresh(docs, "judged")
    judged = docs.withColumn(stats, text_statistics(text_col))
    failed, rule = base_failed(stats), verdict(rules, stats)
    judged = judged.withColumn(
        out,
        F.struct(
            F.col(stats).alias("stats"),
            failed.alias("base_failed"),
            rule.alias("rule"),
            (~failed & rule.isNull()).alias("kept"),
        ),
    ).drop(stats)
    return judged, out
