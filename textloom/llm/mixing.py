"""Mixing sources to target weights by a low-discrepancy schedule (operator 1).

Every source's documents are laid end to end in hashed order and cut into blocks
of equally many words. The mix is a row of slots, one block each: slot order is
the van der Corput sequence, that is, numbers in order of their reversed bits,
and a number belongs to the source in whose stretch of the cumulative weights it
lies. The n-th slot of a source takes its n-th block.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import fresh, stored

#: Weights of the sources in order, repeating; part of all words that they share;
#: most times that a source may be read.
WEIGHTS, SHARE, MOST_PASSES = (3, 1, 2), 1.5, 2
#: Words in a block.
BLOCK_WORDS = 256
#: Documents of a source whose places are worked out together.
BUCKET_DOCS = 4096
#: Numbers of the schedule that are made together.
STRETCH = 1 << 13


def word_count(text: str | Column) -> Column:
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, passes=MOST_PASSES) -> DataFrame:
    """One row per source: source, s (its place by code point, null last), words, docs, target.

    Targets are ``share`` of all words by weight. What is more than ``passes``
    times a source's words is shared anew among the others; each round is one
    sum over the table of sources, and only the sums come to the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    # One row per source is put in order, not one per document.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("s", place).withColumn("weight", weight), "sources")
    most = passes * F.col("words")
    total = sources.agg(F.sum("words")).first()[0] or 0
    whole, level, capped = share * total, 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > most if capped >= 0 else F.lit(False)
        now, full, free = sources.agg(
            F.sum(above.cast("long")), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if not free or now == capped:
            break
        capped, level = now or 0, (whole - (full or 0)) / free
    target = F.least(F.lit(level) * F.col("weight"), most.cast("double"))
    return sources.withColumn("target", target)


def reversed_bits(number: Column, bits: int) -> Column:
    """The schedule's order of numbers below ``2 ** bits``."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(number, b).bitwiseAND(1), bits - 1 - b))
    return out


def rank_in(number: Column, low: Column, high: Column, bits: int) -> Column:
    """How many numbers from ``low`` to before ``high`` come earlier in the schedule.

    An earlier one agrees with ``number`` in its lowest b bits and has 0 where
    ``number`` has 1, for one b; such numbers are one class modulo 2 ** (b + 1).
    """
    out = F.lit(0).cast("long")
    for b in range(bits):
        step = 1 << b + 1
        rest = number.bitwiseAND((1 << b) - 1)
        below = lambda x: F.shiftright(x - rest + (step - 1), b + 1)  # noqa: B023, E731
        out = out + F.shiftright(number, b).bitwiseAND(1) * (below(high) - below(low))
    return out


def schedule(sources: DataFrame) -> DataFrame:
    """(s, block, position) for each block of each source; ``sources`` has s and blocks."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    before = F.sum("blocks").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    low = F.coalesce(before, F.lit(0)).cast("long")
    spans = sources.select("s", low.alias("low"), (low + F.col("blocks")).alias("high")).filter("high > low")
    tasks = max(spark.sparkContext.defaultParallelism, total >> 20)
    starts = spans.withColumn("start", F.explode(F.sequence("low", F.col("high") - 1, F.lit(STRETCH))))
    numbers = starts.repartition(tasks, "s", "start").select(
        "s",
        "low",
        "high",
        F.explode(F.sequence("start", F.least(F.col("start") + STRETCH, F.col("high")) - 1)).alias("number"),
    )
    number, low, high = F.col("number"), F.col("low"), F.col("high")
    return numbers.select(
        "s",
        rank_in(number, low, high, bits).alias("block"),
        reversed_bits(number, bits).alias("position"),
    )


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Add s, words and ``at``, the words before a document in its source's hashed order.

    A source's documents are dealt to buckets by hash, so that a large source is
    placed by many tasks; only one sum per bucket is added up in order.
    """
    rows = dealt(sizes, sources)
    group, earlier = ["s", "bucket", "part"], (Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group).agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("s").orderBy("bucket", "part").rowsBetween(*earlier))
    ahead = sums.select(*group, F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*group).orderBy("h", "doc_id", "row").rowsBetween(*earlier)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(ahead, group).withColumn("at", F.col("ahead") + F.col("inside"))


def dealt(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of ``sizes`` with those of their source, each in a bucket and a part of it.

    Buckets go by the hash of id and text. One that still has more than four
    times its due, because rows repeat, is cut into parts by the rows' own keys.
    """
    count = F.ceil(F.col("docs") / BUCKET_DOCS).cast("long")
    rows = sizes.join(
        sources.select(F.col("source").alias("_source"), "s", "words", "docs", "take"),
        sizes["source"].eqNullSafe(F.col("_source")),
    ).drop("_source")
    low = F.col("h").bitwiseAND((1 << 32) - 1)
    rows = rows.withColumn("bucket", F.shiftright(low * count, 32))
    crowded = (
        rows.groupBy("s", "bucket")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 4 * BUCKET_DOCS)
        .select("s", "bucket", F.ceil(F.col("n") / BUCKET_DOCS).cast("long").alias("parts"))
    )
    # At most three numbers for each 4 * BUCKET_DOCS documents, and only where rows repeat.
    rows = rows.join(F.broadcast(crowded), ["s", "bucket"], "left")
    part = F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts"))
    return rows.withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).drop("parts")


def sized(
    docs: DataFrame, id_col: str, source_col: str, text_col: str, row_col: str | None = None
) -> DataFrame:
    """row, doc_id, source, size and h, a hash of id and text, of every row, written once."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(
        row.alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        F.xxhash64(id_col, text_col, F.lit("mix")).alias("h"),
    )
    return stored(rows, "sizes")


def with_takes(sources: DataFrame, block_words: int) -> DataFrame:
    """Whole words to take from each source, and its blocks."""
    take = F.floor(F.col("target") + 0.5).cast("long")
    sources = sources.withColumn("take", take)
    return sources.withColumn("blocks", F.ceil(F.col("take") / block_words).cast("long"))


def segments(sizes: DataFrame, sources: DataFrame, block_words: int, passes: int) -> DataFrame:
    """The mix: position, s, block, row, doc_id, pass, from_word, to_word.

    Words ``from_word`` to before ``to_word`` of a document stand at the slot
    with that position. Slots in order of position are the mix.
    """
    placed = streams(sizes, sources)
    start, end = F.col("start"), F.col("end")
    drawn = (
        placed.select(
            "s", "row", "doc_id", "size", "take", "words", "at",
            F.explode(F.array(*(F.lit(k).cast("long") for k in range(passes)))).alias("pass"),
        )
        .withColumn("start", F.col("at") + F.col("pass") * F.col("words"))
        .withColumn("end", F.least(F.col("start") + F.col("size"), F.col("take")))
        .filter("end > start")
    )
    first, last = F.floor(start / block_words), F.floor((end - 1) / block_words)
    cut = drawn.withColumn("block", F.explode(F.sequence(first, last)))
    block = F.col("block")
    cut = cut.select(
        "s",
        "block",
        "row",
        "doc_id",
        "pass",
        (F.greatest(start, block * block_words) - start).alias("from_word"),
        (F.least(end, (block + 1) * block_words) - start).alias("to_word"),
    )
    # The schedule grows with the words, which Spark can't tell from its small source: never broadcast.
    return cut.join(schedule(sources.select("s", "blocks")).hint("merge"), ["s", "block"])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights=WEIGHTS,
    share: float = SHARE,
    passes: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, segments) of the mix.

    Null and empty texts have no words and are never drawn. A null source is a
    source of its own, the last. Repeated rows, and rows without an id, count
    each for itself. An empty table gives an empty mix. ``row_col`` may name a
    key of the rows, which is then ``row``.
    """
    sizes = sized(docs, id_col, source_col, text_col, row_col)
    sources = stored(with_takes(targets(sizes, weights, share, passes), block_words), "targets")
    return sizes, sources, segments(sizes, sources, block_words, passes)


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken."""
    sizes, sources, found = mix(docs, **options)
    sums = found.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    own = sources.select(
        F.col("source").alias("_source"), F.col("words").alias("source_size"), F.col("target").alias("target")
    )
    return (
        sizes.join(sums, "row", "left")
        .join(own, F.col("source").eqNullSafe(F.col("_source")))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as many times as the mix reads it, to the nearest whole number.

    Documents cut by the end of their source's share are taken whole or left out.
    Rows that repeat an id, and rows without one, count each for itself.
    """
    row = fresh(docs, "row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    sizes, _, found = mix(keyed, id_col, row_col=row, **options)
    sums = found.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("t"))
    times = sums.join(sizes.select("row", "size"), "row").select(
        F.col("row").alias(row),
        F.floor(F.col("t") / F.col("size") + 0.5).cast("int").alias("times"),
    )
    times = times.filter("times > 0").select(row, F.array_repeat(F.lit(0), F.col("times")).alias("copies"))
    times = times.select(row, F.explode("copies")).select(row)
    return keyed.join(times, row).select(*(F.col(f"`{c}`") for c in docs.columns))
