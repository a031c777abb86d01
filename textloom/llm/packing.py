"""Token ids in fixed-width bit-packed shards (operator 9).

A shard is a header, blocks, an index and a trailer, each followed by one line
feed, as Spark's text writer puts it between rows; the writer commits whole
tasks, to any store that Spark can write to. All integers are little-endian.

* header: ``TLPK``, then unsigned 32-bit version, bits per id, ids per block, shard number
* block: its ids, ``bits`` bits each, low bits first, padded to a whole byte
* index: signed 64-bit ids of documents; one byte per document, 1 where the id is null;
  unsigned 64-bit start of each document in the shard's ids; unsigned 64-bit offset
  of each block in the file
* trailer: unsigned 64-bit offset of the index, documents, blocks, ids, then ``KPLT``

Blocks before the last hold equally many ids, so the block of an id is a
division and its bytes one slice: ``Shard.ids`` unpacks only blocks it needs.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, pieces, stored
from textloom.llm.tokenizing import encoder
from textloom.session import new_folder

#: Bytes of text that a shard is made for.
SHARD_BYTES = 32 << 20
#: Ids in a block.
BLOCK_IDS = 1 << 16
#: First characters of a text that put rows of equal id in order.
HEAD_CHARS = 32

_HEADER, _TRAILER = "<4sIIII", "<QQQQ4s"
_START, _END = b"TLPK", b"KPLT"


def width(size: int) -> int:
    """Bits that hold every id below ``size``."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    each = np.unpackbits(raw, axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack(packed: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    each = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * bits, bitorder="little")
    out = np.zeros((n, 4), np.uint8)
    got = np.packbits(each.reshape(n, bits), axis=1, bitorder="little")
    out[:, : got.shape[1]] = got
    return out.view("<u4").ravel()


class Writer:
    """Rows of one shard's file, from ids that come document by document."""

    def __init__(self, shard: int, bits: int, block_ids: int):
        self.bits, self.block_ids = bits, block_ids
        self.doc_ids: list[int] = []
        self.nulls = bytearray()
        self.starts: list[int] = []
        self.offsets: list[int] = []
        self.rest = b""
        self.n = self.at = 0
        self.header = struct.pack(_HEADER, _START, 1, bits, block_ids, shard)

    def _row(self, row: bytes) -> bytes:
        self.at += len(row) + 1
        return row

    def begin(self) -> bytes:
        return self._row(self.header)

    def add(self, doc_ids: list, ids: list[bytes]) -> Iterator[bytes]:
        for doc_id, own in zip(doc_ids, ids, strict=True):
            self.doc_ids.append(0 if doc_id is None else doc_id)
            self.nulls.append(doc_id is None)
            self.starts.append(self.n)
            self.n += len(own) // 4
        data, size = self.rest + b"".join(ids), 4 * self.block_ids
        whole = len(data) // size * size
        for k in range(0, whole, size):
            yield self._block(data[k : k + size])
        self.rest = data[whole:]

    def _block(self, raw: bytes) -> bytes:
        self.offsets.append(self.at)
        return self._row(pack(np.frombuffer(raw, "<u4"), self.bits))

    def end(self) -> Iterator[bytes]:
        if self.rest:
            yield self._block(self.rest)
        at = self.at
        yield self._row(
            np.array(self.doc_ids, "<i8").tobytes()
            + bytes(self.nulls)
            + np.array(self.starts, "<u8").tobytes()
            + np.array(self.offsets, "<u8").tobytes()
        )
        yield struct.pack(_TRAILER, at, len(self.doc_ids), len(self.offsets), self.n, _END)


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        end = len(content) - 1  # the last line feed
        magic, version, self.bits, self.block_ids, self.number = struct.unpack_from(_HEADER, content)
        at, docs, blocks, self.n, closing = struct.unpack_from(
            _TRAILER, content, end - struct.calcsize(_TRAILER)
        )
        if (magic, version, closing) != (_START, 1, _END):
            raise ValueError("not a packed shard, or cut short")
        read = lambda kind, n, at: np.frombuffer(content, kind, n, at)
        self.doc_ids = read("<i8", docs, at)
        self.nulls = read(np.uint8, docs, at + 8 * docs).astype(bool)
        self.starts = read("<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = read("<u8", blocks, at + 17 * docs).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n - k * self.block_ids)
        at = self.offsets[k]
        return unpack(self.content[at : at + (n * self.bits + 7) // 8], n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to before ``stop``, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of one document after the other; a block is unpacked once."""
        ends = [*self.starts[1:].tolist(), self.n][: len(self.starts)]
        held, low, k = np.zeros(0, "<u4"), 0, 0
        for start, stop in zip(self.starts.tolist(), ends, strict=True):
            parts = [held[start - low :]]
            have = len(parts[0])
            while have < stop - start:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held, low = np.concatenate(parts), start
            yield held[: stop - start]


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write every document's ids, each followed by ``end_id``, in ascending id order.

    Documents are cut into ranges of ids, a shard each, numbered in order. Rows
    without an id come first; rows of equal id are in order of the first
    characters of their text, then of its hash, and may be cut into shards too,
    repeated rows included. A null text is empty and gives just the end id. An
    empty table gives no shard.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.substring(text_col, 1, HEAD_CHARS).alias("head"),
        F.xxhash64(text_col).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    order = ("doc_id", "head", "hash", "row")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = width(max(encoder(tokenizer_path).size, end_id + 1))
    end = np.array([end_id], "<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, writer = encoder(tokenizer_path), None
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["row"])
        for b in batches:
            if writer is None and b.num_rows:
                writer = Writer(TaskContext.get().partitionId(), bits, block_ids)
                yield batch([writer.begin()])
            for ids, texts in zip(pieces(b.column(0)), pieces(b.column(1)), strict=True):
                if made := list(writer.add(ids, [e + end for e in encoding.encode(texts)])):
                    yield batch(made)
        if writer is not None:
            yield batch(list(writer.end()))

    (
        rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", as_bytes("text").alias("text"))
        .mapInArrow(shard, "row binary")
        .select(F.col("row").cast("string").alias("value"))
        .write.text(path, lineSep="\n")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: shard, doc_id, shard_start, n_tokens, ids_crc32."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in (c.as_py() for c in b.column(0)):
                if not content:
                    continue
                shard = Shard(content)
                each = [(len(i), zlib.crc32(i.tobytes())) for i in shard.documents()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.number] * len(each), pa.int64()),
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls),
                        pa.array(shard.starts, pa.int64()),
                        pa.array([n for n, _ in each], pa.int64()),
                        pa.array([c for _, c in each], pa.int64()),
                    ],
                    ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(
        parse, "shard long, doc_id long, shard_start long, n_tokens long, ids_crc32 long"
    )


def with_starts(found: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before, to the rows of ``read_documents``.

    One row per shard, some megabytes of ids each, is all that is put in order.
    """
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = totals.select("shard", F.coalesce(before, F.lit(0)).alias("_before"))
    return found.join(shards, "shard").select(
        "doc_id",
        (F.col("_before") + F.col("shard_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
    )


def packed_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write shards (to the shared folder, without a path), read them back, and place each document."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "packed")
    write_shards(docs, path, tokenizer_path, **options)
    return with_starts(stored(read_documents(spark, path), "packed-index"))
