"""Near-duplicates by SimHash with bit-sliced comparison (operator 3)."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, fresh, stored, values

#: Words in a shingle, seed of its hash, and bits in which linked fingerprints may differ.
WORDS, SEED, RADIUS = 3, 42, 3
#: Most fingerprints of a bucket that one group of rows takes; larger buckets are tiled.
TILE = 4096
#: Words hashed before their bits are added up.
_RUN = 1 << 15


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority bits of the hashes of all shingles of one text; 0 without a word."""
    parts = text.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    n = len(parts) - words + 1
    if n < 2:
        return digest(line, seed)
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    ends = [s - 1 for s in starts[words:]] + [len(line)]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _RUN):
        own = [digest(line[a:b], seed) for a, b in zip(starts[k : min(n, k + _RUN)], ends[k : k + _RUN])]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: str | Column, words: int = WORDS, seed: int = SEED) -> Column:
    """Fingerprint of a text column, its 64 bits as a signed long."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        own = np.array([fingerprint(t, words, seed) for t in values(texts)], np.uint64)
        return pa.array(own.view(np.int64))

    return run(as_bytes(text))


class Planes:
    """Fingerprints stored vertically: plane b holds bit b of all of them, 64 to a word."""

    #: Words of a plane that are given up together.
    BLOCK = 16

    def __init__(self, prints: np.ndarray):
        self.n = len(prints)
        words = -(-self.n // (64 * self.BLOCK)) * self.BLOCK
        bits = np.zeros((words * 64, 64), np.uint8)
        bits[: self.n] = np.unpackbits(
            np.ascontiguousarray(prints, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        flat = np.packbits(bits.T.copy(), axis=1, bitorder="little")
        self.planes = flat.view("<u8").reshape(64, words // self.BLOCK, self.BLOCK)
        ones = np.zeros(words * 64, np.uint8)
        ones[: self.n] = 1
        self.live = np.packbits(ones, bitorder="little").view("<u8").reshape(-1, self.BLOCK).copy()

    def drop(self, places: np.ndarray) -> None:
        """Leave these fingerprints out of later searches."""
        word, bit = places >> 6, np.uint64(1) << (places & 63).astype(np.uint64)
        np.bitwise_and.at(self.live.reshape(-1), word, ~bit)

    def within(self, one: int, radius: int) -> np.ndarray:
        """Places of live fingerprints at most ``radius`` bits from ``one``.

        A differing bit of each fingerprint is carried into three counter planes
        (carry-save: count 1, 2, 4) and a plane that says 8 or more. After every
        eight bits, blocks in which all have exceeded the radius are given up.
        """
        blocks = np.flatnonzero(self.live.any(axis=1))
        one_, two, four, over = (np.zeros((len(blocks), self.BLOCK), np.uint64) for _ in range(4))
        for first in range(0, 64, 8):
            for b in range(first, first + 8):
                differs = self.planes[b, blocks]
                if one >> b & 1:
                    differs = ~differs
                carry = one_ & differs
                one_ ^= differs
                carry2 = two & carry
                two ^= carry
                over |= four & carry2
                four ^= carry2
            out = over | _beyond(one_, two, four, radius)
            hold = ((~out) & self.live[blocks]).any(axis=1)
            if not hold.all():
                blocks = blocks[hold]
                one_, two, four, over = (x[hold] for x in (one_, two, four, over))
                out = out[hold]
            if not len(blocks):
                return np.zeros(0, np.int64)
        near = ~out & self.live[blocks]
        bits = np.unpackbits(near.view(np.uint8).reshape(len(blocks), -1), axis=1, bitorder="little")
        row, place = np.nonzero(bits)
        return blocks[row] * (64 * self.BLOCK) + place


def _beyond(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Bits set where the count in the three planes is more than ``radius`` (0 to 7)."""
    equal, more = np.full_like(one, ~np.uint64(0)), np.zeros_like(one)
    for plane, bit in ((four, 4), (two, 2), (one, 1)):
        if radius & bit:
            equal = equal & plane
        else:
            more = more | (equal & plane)
            equal = equal & ~plane
    return more


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all that chains of links connect: fewer than fingerprints.

    Goes outwards from one fingerprint after another; what is reached is not
    searched for again, so a dense group costs few searches over what is left.
    """
    planes = Planes(prints)
    links: list[tuple[int, int]] = []
    new = np.ones(len(prints), bool)
    for root in range(len(prints)):
        if not new[root]:
            continue
        new[root] = False
        planes.drop(np.array([root]))
        front = [root]
        while front:
            k = front.pop()
            near = planes.within(int(prints[k]), radius)
            if len(near):
                planes.drop(near)
                new[near] = False
                links += [(k, int(j)) for j in near]
                front += near.tolist()
    return links


def block_masks(radius: int) -> list[int]:
    """Bits that must agree, for each choice of two among radius + 2 blocks of bits.

    Fingerprints that differ in at most ``radius`` bits agree on two blocks at least.
    """
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(radius: int):
    """Takes rows sorted by group; gives the links of each group's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept_prints = [], []

        def links(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate([[0], change, [len(keys)]])
            sizes = np.diff(bounds)
            left, right = [], []
            pairs = bounds[:-1][sizes == 2]
            a, b = prints[pairs], prints[pairs + 1]
            near = np.bitwise_count(a ^ b) <= radius
            left.append(a[near])
            right.append(b[near])
            for start, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
                own = prints[start : start + size]
                if found := forest(own, radius):
                    x, y = np.array(found).T
                    left.append(own[x])
                    right.append(own[y])
            out = [np.concatenate(x).view(np.int64) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], axis=1)
            prints = batch.columns[-1].to_numpy(zero_copy_only=False).view(np.uint64)
            # The last group may go on in the next batch.
            last = int(np.argmax((keys == keys[-1]).all(axis=1)))
            if last:
                yield from links(
                    np.concatenate([*kept_keys, keys[:last]]), np.concatenate([*kept_prints, prints[:last]])
                )
                kept_keys, kept_prints = [keys[last:]], [prints[last:]]
            elif kept_keys and (kept_keys[-1][-1] != keys[-1]).any():
                yield from links(np.concatenate(kept_keys), np.concatenate(kept_prints))
                kept_keys, kept_prints = [keys], [prints]
            else:
                kept_keys.append(keys)
                kept_prints.append(prints)
        if kept_keys:
            yield from links(np.concatenate(kept_keys), np.concatenate(kept_prints))

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints within ``radius`` bits, directly or in chains.

    ``prints`` has distinct values in column ``fp``. Each goes to one bucket per
    choice of agreeing blocks, and buckets are searched by themselves. A bucket
    of more than ``tile`` fingerprints is cut into parts, and each pair of parts
    is searched as a group of its own, so no task holds more than two parts;
    no fingerprint is left out.
    """
    masks = block_masks(radius)
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("m", "key"),
    )
    counts = keyed.groupBy("m", "key").agg(F.count("*").alias("n"))
    large = counts.filter(F.col("n") > tile).select(
        "m", "key", F.ceil(2 * F.col("n") / tile).cast("int").alias("parts")
    )
    part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    sized = keyed.join(large, ["m", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    grouped = sized.withColumn("part", part).select(
        "m",
        "key",
        "part",
        F.explode(others).alias("other"),
        "fp",
    )
    rows = grouped.select(
        F.col("m").cast("long").alias("m"),
        "key",
        F.least("part", "other").cast("long").alias("low"),
        F.greatest("part", "other").cast("long").alias("high"),
        "fp",
    )
    group = ["m", "key", "low", "high"]
    return (
        rows.repartition(*group)
        .sortWithinPartitions(*group)
        .mapInArrow(_bucket_links(radius), "a long, b long")
        .filter("a <> b")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of a link is connected to.

    Rounds of large-star and small-star: neighbours are hung on the smallest one
    around, until nothing changes. Each round is written once. A node with very
    many links meets them only in sums, and loses them to the smallest in a round.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"))
        # Large star: every larger neighbour of a node is linked to the smallest around it.
        large = (
            both.filter("b > a")
            .join(smallest, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        # Small star: a node's smaller neighbours, and itself, are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _placed(own: DataFrame, radius: int, tile: int) -> DataFrame:
    """fp, root and first of distinct fingerprints with ``first``: root is alike in a component."""
    roots = stored(components(near_links(own.select("fp"), radius, tile)), "roots")
    return own.join(roots, own["fp"] == roots["node"], "left").select(
        own["fp"], F.coalesce("root", "fp").alias("root"), "first"
    )


def linked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id of the documents reachable over links. Null
    and empty texts have fingerprint zero and are linked like others. Rows
    without an id are linked too, but are nobody's smallest; a component of
    such rows alone has a null component_id. Repeated rows are each kept. Equal
    fingerprints count once in the search, however many documents share them.
    """
    found = stored(
        docs.select(F.col(id_col).alias("doc_id"), fingerprints(text_col, words).alias("fp")), "fingerprints"
    )
    own = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = _placed(own, radius, tile)
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    # Only components of several fingerprints need the second lookup.
    classes = stored(placed.join(smallest, "root").select("fp", "component_id"), "classes")
    return found.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """One row of each component, all columns kept: that with the smallest id.

    Rows are told apart by a key of their own, written once. Rows without an id
    come last, so they stay only where no row of the component has one; of equal
    ids one row stays. An id whose texts are in several components may stay for each.
    """
    row = fresh(docs, "row")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = stored(keyed.select(first.alias("first"), fingerprints(text_col, words).alias("fp")), "fingerprints")
    own = stored(found.groupBy("fp").agg(F.min("first").alias("first")), "own")
    kept = _placed(own, radius, tile).groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.row").alias(row))
    return keyed.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
