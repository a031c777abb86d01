"""Near copies by SimHash sketches of word shingles (near-duplicate stage of the pipeline).

A text's sketch is the majority of its shingles' hashes in 256 bits. Sketches meet in
buckets by bands of MinHashes and are compared there with bit planes and carry-save
counters; blocks that all exceed the radius are given up. Whole sets of shingles decide
about what is left. Two texts of similarity s share a band with 1 - (1 - s ** ROWS) ** BANDS,
0.9999 at 0.8; their sketches differ in about 39 bits there, 6 more or less, and the radius is 80.
Fingerprints of 64 bits alone can't afford a similarity of 0.8: they differ in about 10 bits, and
blocks that agree within such a radius are too short to tell texts apart.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import shingles
from textloom.llm.common import as_bytes, fresh, stored, values
from textloom.llm.shingles import hashes, similarity

__all__ = ["hashes", "similarity", "bands", "sketch", "Planes", "near", "one_of_each"]

#: Words in a shingle, and least similarity of linked texts.
WORDS, SIMILARITY = 5, 0.8
#: Bands of a text, and MinHashes in a band.
BANDS, ROWS = 24, 5
#: Bits of a sketch, and most that candidates differ in.
BITS, RADIUS = 256, 80
#: Shingles whose bits are added up together.
_RUN = 1 << 12

_HASHES = shingles.MinHashes(BANDS * ROWS)
_STEPS = np.arange(BITS // 64, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)


def bands(own: np.ndarray) -> list[int]:
    """A number for each band of MinHashes, signed as Spark's long."""
    rows = _HASHES.of(own).astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(rows)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Further hashes of hashes, well mixed in all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(own: np.ndarray) -> bytes:
    """The majority of each of BITS bits over a set of hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(own), _RUN):
        part = _mixed(own[k : k + _RUN] + _STEPS).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(len(_STEPS), -1, 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.int64).ravel()
    return np.packbits(2 * ones > len(own), bitorder="little").tobytes()


class Planes:
    """Sketches stored vertically: plane b holds bit b of all of them, 64 to a word."""

    #: Words of a plane that are given up together, and bits counted before that is looked at.
    BLOCK, LOOK = 8, 64

    def __init__(self, sketches: np.ndarray):
        self.n, size = sketches.shape
        words = -(-self.n // (64 * self.BLOCK)) * self.BLOCK
        self.bits = np.unpackbits(sketches, axis=1, bitorder="little")
        upright = np.zeros((8 * size, words * 64), np.uint8)
        upright[:, : self.n] = self.bits.T
        self.planes = np.packbits(upright, axis=1, bitorder="little").view("<u8").reshape(8 * size, -1, self.BLOCK)
        ones = np.zeros(words * 64, np.uint8)
        ones[: self.n] = 1
        self.live = np.packbits(ones, bitorder="little").view("<u8").reshape(-1, self.BLOCK).copy()

    def drop(self, places: np.ndarray) -> None:
        """Leave these sketches out of later searches."""
        word, bit = places >> 6, np.uint64(1) << (places & 63).astype(np.uint64)
        np.bitwise_and.at(self.live.reshape(-1), word, ~bit)

    def within(self, one: int, radius: int) -> np.ndarray:
        """Places of live sketches at most ``radius`` bits from that at place ``one``.

        Two differing bits at a time are added to counters kept as planes: their sum
        and carry go up the planes like a carry that is saved, not awaited.
        """
        width = int(radius).bit_length() + 1
        blocks = np.flatnonzero(self.live.any(axis=1))
        counts = [np.zeros((len(blocks), self.BLOCK), np.uint64) for _ in range(width)]
        over = np.zeros((len(blocks), self.BLOCK), np.uint64)
        flip = np.where(self.bits[one], ~np.uint64(0), np.uint64(0))
        near = self.live[blocks]
        for first in range(0, len(self.planes), self.LOOK):
            for b in range(first, min(first + self.LOOK, len(self.planes)), 2):
                x, y = self.planes[b, blocks] ^ flip[b], self.planes[b + 1, blocks] ^ flip[b + 1]
                # Full adder of the lowest plane and both bits; its carry goes on upwards.
                half = x ^ y
                carry = (x & y) | (half & counts[0])
                counts[0] = counts[0] ^ half
                for p in range(1, width):
                    carry, counts[p] = counts[p] & carry, counts[p] ^ carry
                    if not carry.any():
                        break
                else:
                    over |= carry
            near = ~(over | _beyond(counts, radius)) & self.live[blocks]
            hold = near.any(axis=1)
            if not hold.all():
                blocks, over, near = blocks[hold], over[hold], near[hold]
                counts = [c[hold] for c in counts]
            if not len(blocks):
                return np.zeros(0, np.int64)
        bits = np.unpackbits(near.view(np.uint8).reshape(len(blocks), -1), axis=1, bitorder="little")
        row, place = np.nonzero(bits)
        return blocks[row] * (64 * self.BLOCK) + place


def _beyond(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where the count in the planes is more than ``radius``."""
    equal, more = np.full_like(counts[0], ~np.uint64(0)), np.zeros_like(counts[0])
    for p in range(len(counts) - 1, -1, -1):
        if radius >> p & 1:
            equal = equal & counts[p]
        else:
            more = more | (equal & counts[p])
            equal = equal & ~counts[p]
    return more


def near(sketches: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all sketches which chains of small distance connect: fewer than sketches."""
    if len(sketches) == 2:
        return [(0, 1)] if np.bitwise_count(sketches[0] ^ sketches[1]).sum() <= radius else []
    planes = Planes(np.ascontiguousarray(sketches))
    links: list[tuple[int, int]] = []
    new = np.ones(len(sketches), bool)
    for root in range(len(sketches)):
        if not new[root]:
            continue
        new[root] = False
        planes.drop(np.array([root]))
        front = [root]
        while front and new.any():
            k = front.pop()
            found = planes.within(k, radius)
            if len(found):
                planes.drop(found)
                new[found] = False
                links += [(k, int(j)) for j in found]
                front += found.tolist()
    return links


_PRINT = pa.struct([("same", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def prints(text: str | Column, words: int = WORDS) -> Column:
    """Digest of a text's set of shingles, its bands and its sketch."""

    @F.arrow_udf("struct<same:binary,bands:array<bigint>,sketch:binary>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in values(texts):
            own = hashes(t, words)
            out.append({"same": shingles.digest(own), "bands": bands(own), "sketch": sketch(own)})
        return pa.array(out, _PRINT)

    return run(as_bytes(text))


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: float = SIMILARITY,
    tile: int = shingles.TILE,
    tile_bytes: int = shingles.TILE_BYTES,
) -> DataFrame:
    """One row of each component of near copies, all columns kept: that with the smallest id.

    Texts are linked when ``least`` or more of their distinct shingles together are
    in both; case (A-Z) and white space don't count, and texts without a word are
    alike. Rows without an id come last, so they stay only where no row of the
    component has one; of equal ids one row stays. No documents, no rows.
    """
    row = fresh(docs, "row")
    read = shingles.with_row(docs, row)
    found = read.select(
        F.col(row).alias("row"),
        F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("first"),
        F.octet_length(as_bytes(text_col)).cast("long").alias("bytes"),
        prints(text_col, words).alias("print"),
    )
    found = stored(found.select("row", "first", "bytes", "print.*"), "prints")
    # Equal sets of shingles count once, however many rows share them.
    own = found.groupBy(F.col("same").alias("node")).agg(
        F.min("first").alias("first"),
        F.min_by(F.struct("row", "bytes"), "row").alias("at"),
        F.any_value("bands").alias("bands"),
        F.any_value("sketch").alias("sketch"),
    )
    own = stored(own.select("node", "first", "at.*", "bands", "sketch"), "own")
    texts = read.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    keyed = own.select("node", F.explode("bands").alias("key"))
    nodes = own.select("node", "row", "bytes", "sketch")
    roots = shingles.near_roots(nodes, keyed, texts, near, words, least, tile, tile_bytes)
    placed = own.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return read.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
