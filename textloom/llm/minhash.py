"""Near-duplicates by MinHash with tensored banding (operator 12).

Two collections of HALVES hash keys, each of ROWS MinHashes, are combined pairwise:
each pair of a key from the first and one from the second is the key of a table, so
HALVES ** 2 tables need 2 * HALVES * ROWS MinHashes only. Texts of similarity s meet in
a table with (1 - (1 - s ** ROWS) ** HALVES) ** 2: 0.9998 at 0.85, 0.999995 at 0.9. A key
that no other text has is left out before keys are combined, as its tables hold one text.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import shingles
from textloom.llm.common import as_bytes, fresh, stored, values

#: Words in a shingle, and least similarity of linked texts.
WORDS, SIMILARITY = 3, 0.85
#: Keys in each collection, and MinHashes in a key.
HALVES, ROWS = 10, 3
#: MinHashes, of 60, in which the sketches of candidates agree: four deviations below what 0.85 gives.
AGREE = 40

_HASHES = shingles.MinHashes(2 * HALVES * ROWS)


def keys_and_sketch(own: np.ndarray) -> tuple[list[int], bytes]:
    """A set's keys, those of the first collection first, and 16 bits of each MinHash."""
    least = _HASHES.of(own)
    rows = least.astype("<u8").reshape(2 * HALVES, ROWS)
    # Signed, as Spark's long.
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]
    return keys, (least >> np.uint64(48)).astype("<u2").tobytes()


_PRINT = pa.struct([("same", pa.binary()), ("n", pa.int64()), ("halves", pa.list_(pa.int64())), ("sketch", pa.binary())])


def prints(text: str | Column, words: int = WORDS) -> Column:
    """Digest and size of a text's set, its keys and its sketch; an empty set has neither."""

    @F.arrow_udf("struct<same:binary,n:bigint,halves:array<bigint>,sketch:binary>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in values(texts):
            own = shingles.hashes(t, words)
            keys, sketch = keys_and_sketch(own) if len(own) else (None, None)
            out.append({"same": shingles.digest(own), "n": len(own), "halves": keys, "sketch": sketch})
        return pa.array(out, _PRINT)

    return run(as_bytes(text))


def alike(sketches: np.ndarray, least: int = AGREE) -> list[tuple[int, int]]:
    """Links that connect all sketches which chains of enough agreement connect: fewer than sketches."""
    own = np.ascontiguousarray(sketches).view("<u2")
    if len(own) == 2:
        return [(0, 1)] if (own[0] == own[1]).sum() >= least else []
    new = np.arange(len(own))
    links: list[tuple[int, int]] = []
    while len(new):
        front, new = [int(new[0])], new[1:]
        while front and len(new):
            k = front.pop()
            near = (own[new] == own[k]).sum(axis=1) >= least
            links += [(k, int(j)) for j in new[near]]
            front += new[near].tolist()
            new = new[~near]
    return links


def tables(own: DataFrame) -> DataFrame:
    """(node, key) of the tables that a node may share with others; own (node, halves)."""
    halves = own.select("node", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("slot", "half").agg(F.count("*").alias("n")).filter("n > 1").select("slot", "half")
    left = halves.join(shared, ["slot", "half"], "left_semi")
    kept = left.groupBy("node").agg(F.collect_list(F.struct("slot", "half")).alias("own"))
    kept = stored(kept, "halves")
    pairs = F.transform(
        F.filter("own", lambda a: a["slot"] < HALVES),
        lambda a: F.transform(F.filter("own", lambda b: b["slot"] >= HALVES), lambda b: F.xxhash64(a, b)),
    )
    return kept.select("node", F.explode(F.flatten(pairs)).alias("key"))


def linked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: float = SIMILARITY,
    tile: int = shingles.TILE,
    tile_bytes: int = shingles.TILE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when ``least`` or more of their distinct shingles together are in
    both, which whole sets decide. component_id is the smallest id of the rows reachable
    over links. Case (A-Z) and white space don't count. Texts without a word, and null,
    have an empty set and are linked with nothing. Rows without an id are linked too but
    are nobody's smallest; where a component has no id at all, its component_id is null and
    all its rows are kept. Repeated rows are each returned, and equal sets are compared once.
    """
    row = fresh(docs, "row")
    read = shingles.with_row(docs, row)
    found = read.select(
        F.col(id_col).alias("doc_id"),
        F.col(row).alias("row"),
        F.octet_length(as_bytes(text_col)).cast("long").alias("bytes"),
        prints(text_col, words).alias("print"),
    )
    found = stored(found.select("doc_id", "row", "bytes", "print.*"), "prints")
    full = found.filter("n > 0")
    own = full.groupBy(F.col("same").alias("node")).agg(
        F.min("doc_id").alias("first"),
        F.min_by(F.struct("row", "bytes"), "row").alias("at"),
        F.any_value("halves").alias("halves"),
        F.any_value("sketch").alias("sketch"),
    )
    own = stored(own.select("node", "first", "at.*", "halves", "sketch"), "own")
    texts = read.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    nodes = own.select("node", "row", "bytes", "sketch")
    roots = shingles.near_roots(nodes, tables(own), texts, alike, words, least, tile, tile_bytes)
    placed = own.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(smallest, "root").select(F.col("node").alias("same"), "component_id")
    placed = full.select("doc_id", "n", "same").join(classes, "same")
    alone = found.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    both = placed.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", "component_id"))
    return both.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
