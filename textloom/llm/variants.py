"""Spelling variants of words by permuterm rotations (operator 11).

A word ``w`` with its terminator ``$`` has one rotation for each place to start at.
The rotation that starts after an edited character ends with that character, so
the rest of it, its prefix, says everything but the edit: words that share the
prefix differ by a replacement there, and a word whose whole rotation is that
prefix lacks the character. With every rotation sorted under itself and under its
prefix, neighbours lie next to each other in groups no larger than the alphabet.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, stored, values

#: Maximal runs of letters, and the terminator, which is none of them.
RUNS, END = "[A-Za-zÀ-ÿ]+", "$"
#: Fewest letters and occurrences of a word; how much more often a form occurs.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: One run in so many loses a letter, by its checksum.
EDITED = 199
#: Distinct words a task counts before it passes them on.
HELD = 200_000

_CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def edited(number: str, run: str, prefix: int, every: int = EDITED) -> str:
    """``run`` of row ``number``, without a letter where the checksum says so; ``prefix`` is the crc32 of "number:"."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    occurrences: int = OCCURRENCES,
    every: int = EDITED,
) -> DataFrame:
    """(word, n) of words with enough letters and occurrences in all texts together.

    Tasks add up what they read, some HELD words at a time, before words meet.
    """
    find = re.compile(RUNS).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                if not text:
                    continue
                number = "" if number is None else str(number)
                prefix = zlib.crc32(f"{number}:".encode())
                for run, n in Counter(find(text.translate(_CAPITALS))).items():
                    word = edited(number, run, prefix, every)
                    if len(word) >= letters:
                        total[word] += n
                if len(total) >= HELD:
                    yield out()
                    total = Counter()
        yield out()

    read = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    counted = read.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, at, shorter) of ``words`` (word, n): every rotation, whole and without its last letter.

    ``at`` is -1 for a whole rotation, else the place of the letter that the key
    skips; ``shorter`` says that deleting there is not the same as deleting one place before.
    """
    length = F.length("word")
    begin = F.explode(F.sequence(F.lit(0), length))
    turned = words.select("word", "n", begin.alias("k"))
    # Letters from place k on, the terminator, and the letters before place k.
    tail = F.col("word").substr(F.col("k") + 1, F.length("word"))
    whole = F.concat(tail, F.lit(END), F.col("word").substr(F.lit(1), F.col("k")))
    cut = F.concat(tail, F.lit(END), F.col("word").substr(F.lit(1), F.col("k") - 1))
    letter, earlier = (F.col("word").substr(F.col("k") - x, F.lit(1)) for x in (0, 1))
    first = (F.col("k") == 1) | (letter != earlier)
    entries = F.array(
        F.struct(whole.alias("key"), F.lit(-1).alias("at"), F.lit(False).alias("shorter")),
        F.when(F.col("k") > 0, F.struct(cut.alias("key"), (F.col("k") - 1).alias("at"), first.alias("shorter"))),
    )
    return turned.select("word", "n", F.explode(F.array_compact(entries)).alias("e")).select("e.*", "word", "n")


def _best(own: list[tuple]) -> list[tuple]:
    """For each (-n, word) of ``own`` the smallest other one, or None."""
    if len(own) < 2:
        return [None] * len(own)
    low, second = sorted(own)[:2]
    return [second if x == low else low for x in own]


def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(word, near, (-n, word) of the most frequent near word) for each member of a group of rows of equal key.

    ``rows`` (key, at, shorter, word, n) come sorted by key. A group has the words that differ in the
    skipped letter, at most one of each letter, and at most one word that lacks it.
    """
    for _, group in groupby(rows, itemgetter(0)):
        replaced, lacking = [], None
        for _, at, shorter, word, n in group:
            if at < 0:
                lacking = (-n, word)
            else:
                replaced.append(((-n, word), shorter))
        if len(replaced) + (lacking is not None) < 2:
            continue
        words = [x for x, _ in replaced]
        inserted = [x for x, shorter in replaced if shorter]
        if lacking and inserted:
            yield lacking[1], len(inserted), min(inserted)
        for (own, shorter), best in zip(replaced, _best(words)):
            near = len(words) - 1
            if lacking and shorter:
                near += 1
                best = lacking if best is None else min(best, lacking)
            if near:
                yield own[1], near, best


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words, by sorted rotations.

    A pair of near words meets in exactly one group: a replacement has one
    place, and of letters alike in a row only the first counts as the one deleted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            word, near, n, best = zip(*((w, k, -b[0], b[1]) for w, k, b in out)) if out else ((),) * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((word, near, n, best), kinds)], ["word", "near", "n", "best"]
            )

        for one in scan(rows()):
            out.append(one)
            if len(out) >= 1 << 14:
                yield flushed()
                out = []
        yield flushed()

    entries = rotations(words).select("key", "at", "shorter", "word", "n")
    sorted_ = entries.repartitionByRange("key").sortWithinPartitions("key")
    found = sorted_.mapInArrow(run, "word string, near long, n long, best string")
    return found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "best")).alias("best")
    ).select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms followed to the last one, twice as far each round.

    Counts grow along a chain, so it has no loops and is soon at its end.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        ahead = stored(ahead, "forms")
        now = ahead.select("word", "root")
        if ahead.filter(F.col("further").isNotNull()).isEmpty():
            return now


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    occurrences: int = OCCURRENCES,
    ratio: int = RATIO,
    every: int = EDITED,
) -> DataFrame:
    """A row for each word: word, n, n_near, form, form_n, root.

    Null and empty texts have no words; a null id counts as an empty one in the
    checksum. Repeated rows count each time. Of near words that are equally
    frequent the first in code-point order is the form. No documents, no rows.
    """
    words = stored(word_counts(docs, id_col, text_col, letters, occurrences, every), "words")
    near = stored(neighbours(words), "near")
    placed = words.join(near, "word", "left")
    often = F.col("best_n") >= ratio * F.col("n")
    placed = placed.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best")).alias("form"),
        F.when(often, F.col("best_n")).alias("form_n"),
    )
    placed = stored(placed, "placed")
    ends = roots(placed.filter(F.col("form").isNotNull()).select("word", "form"))
    return placed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
