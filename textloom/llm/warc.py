"""Zstandard WARC archives, written and read (operator 4).

An archive begins with a skippable frame that holds the dictionary of the others; then
each record is a frame of its own. Spark's text writer puts an empty skippable
frame after each row, which Zstandard readers pass over, so archives are written by
ordinary committed tasks to any store that Spark can write to.
"""

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, values
from textloom.session import new_folder

#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 0
#: Compressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Dictionary bytes, and bytes of an archive's first records that it is made from.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 512 << 10
LEVEL = 3
#: WARC-Date of every record.
DATE = "2025-01-01T00:00:00Z"

# Fixed values of the formats
_MAGIC, _SKIPPABLE, _DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
_AFTER_ROW = (_SKIPPABLE).to_bytes(4, "little") + bytes(4)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class BadArchive(ValueError):
    """An archive or record that breaks its format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def record_id(page_id: int | None, again: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'page {page_id}{again}')}>"


def _plain(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(
    page_id: int | None, url: str | None, digest: bytes, n_bytes: int, payload: bytes | None, first: int | None
) -> bytes:
    """A response with its payload, or, without one, a revisit of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_plain(url)}")
    if payload is None:
        head += [f"WARC-Refers-To: {record_id(first)}", f"Refers-To-Page-ID: {first}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """Checks the version, mandatory headers, content length, closing lines and payload digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", version):
        raise BadArchive("no WARC version and headers")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"bad header {line!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadArchive(f"no {name}")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("content length and record length differ")
    record = Record(headers, rest[:-4])
    if headers["warc-type"] == "response":
        own = base64.b32encode(hashlib.sha1(record.payload).digest()).decode()
        if headers.get("warc-payload-digest", f"sha1:{own}") != f"sha1:{own}":
            raise BadArchive("payload and its digest differ")
    return record


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on some records; where they are too few or alike, their own last bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _with_dictionary(content: bytes):
    return zstandard.ZstdCompressionDict(content) if content else None


def skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its block headers."""
    try:
        described = data[at + 4]
        single = described >> 5 & 1
        size = (1, 2, 4, 8)[described >> 6] if described >> 6 or single else 0
        at += 5 + (0 if single else 1) + (0, 1, 2, 4)[described & 3] + size
        while True:
            block = int.from_bytes(data[at : at + 3], "little")
            if at + 3 > len(data):
                raise BadArchive("a frame is cut short")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
    except IndexError:
        raise BadArchive("a frame is cut short") from None
    at += 4 * (described >> 2 & 1)
    if at > len(data):
        raise BadArchive("a frame is cut short")
    return at


def read_archive(content: bytes) -> Iterator[Record]:
    """The records of an archive's bytes, one frame at a time."""
    data = memoryview(content)
    at, first = 0, True
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & ~0xF == _SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                raise BadArchive("a skippable frame is cut short")
            if first and magic == _DICTIONARY:
                held = bytes(data[at + 8 : end])
                if held[:4] == _MAGIC.to_bytes(4, "little"):
                    held = zstandard.ZstdDecompressor().decompress(held)
                reader = zstandard.ZstdDecompressor(dict_data=_with_dictionary(held))
            at = end
        elif magic == _MAGIC:
            end = frame_end(data, at)
            try:
                plain = reader.decompressobj().decompress(data[at:end])
            except zstandard.ZstdError as error:
                raise BadArchive(f"bad frame: {error}") from error
            yield parse_record(plain)
            at = end
        else:
            raise BadArchive("neither a frame nor a skippable frame")
        first = False


def with_revisits(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, n_bytes, first.

    Only digests are grouped. Pages meet the smallest id of their payload in a
    join that Spark splits where one payload has very many copies.
    """
    payload = as_bytes(html_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )
    long_enough = F.col("n_bytes") >= least
    known = rows.filter(long_enough).groupBy("digest", "n_bytes")
    shared = known.agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    shared = shared.filter("copies > 1 and first is not null").drop("copies")
    joined = rows.join(shared, ["digest", "n_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.unhex("digest").alias("digest"),
        "n_bytes",
        F.when(revisit, F.col("first")).alias("first"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    least: int = LEAST_REVISIT,
    archive_bytes: int = ARCHIVE_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write a record per row, in folders ``archive=…`` of ``path`` with a file each.

    A null payload is empty. Of equal payloads of at least ``least`` bytes the
    page with the smallest id is the response; rows without an id revisit it,
    but are responses among themselves, and repeated rows of the smallest id are
    all responses. An empty table gives no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, seq, size = TaskContext.get().partitionId(), -1, 0, 0
        waiting: list[bytes] = []
        compressor = None

        def batch(frames: list[bytes]) -> pa.RecordBatch:
            nonlocal seq, size
            n, seq = seq, seq + len(frames)
            size += sum(map(len, frames))
            columns = [
                pa.array([f"{task:06d}-{archive:04d}"] * len(frames)),
                pa.array(range(n, seq), pa.int64()),
                pa.array(frames, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["archive", "seq", "frame"])

        def begin() -> pa.RecordBatch:
            """A new archive, from the records that wait for it."""
            nonlocal archive, seq, size, compressor
            archive, seq, size = archive + 1, 0, 0
            held = dictionary(waiting)
            compressor = zstandard.ZstdCompressor(LEVEL, dict_data=_with_dictionary(held), write_checksum=True)
            out = batch([skippable(_DICTIONARY, held), *map(compressor.compress, waiting)])
            waiting.clear()
            return out

        held_bytes = 0
        for b in batches:
            frames: list[bytes] = []
            for row in values(pa.StructArray.from_arrays(b.columns, names=b.schema.names)):
                record = record_bytes(
                    row["page_id"], row["url"], row["digest"], row["n_bytes"], row["payload"], row["first"]
                )
                if compressor is None:
                    waiting.append(record)
                    held_bytes += len(record)
                    if held_bytes >= SAMPLE_BYTES:
                        yield begin()
                        held_bytes = 0
                else:
                    frames.append(compressor.compress(record))
                    if len(frames) == 256:
                        yield batch(frames)
                        frames = []
                        if size >= archive_bytes:
                            compressor = None
            if frames:
                yield batch(frames)
        if waiting:
            yield begin()

    (
        with_revisits(pages, least, id_col, url_col, html_col)
        .mapInArrow(write, "archive string, seq long, frame binary")
        .sortWithinPartitions("archive", "seq")
        .select("archive", F.col("frame").cast("string").alias("value"))
        .write.partitionBy("archive")
        .text(path, lineSep=_AFTER_ROW.decode())
    )


RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    A damaged archive ends the job with ``BadArchive``. The payload of a revisit
    is null, as it is ``payloads=False`` for all.
    """

    def row(record: Record) -> dict:
        h = record.headers
        http = dict(re.findall(rb"(?m)^([\w-]+): *([^\r]*)", record.block.partition(b"\r\n\r\n")[0]))
        number = lambda x: int(h[x]) if x in h else None
        kind, n = h["warc-type"], int(http.get(b"Content-Length", b"0"))
        if kind == "response" and n != len(record.payload):
            raise BadArchive("HTTP content length and payload differ")
        return {
            "page_id": number("page-id"),
            "url": h.get("warc-target-uri"),
            "record_type": kind,
            "payload_bytes": n,
            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": number("refers-to-page-id"),
            "payload": record.payload if payloads and kind == "response" else None,
        }

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip([c.split()[0] for c in RECORD.split(", ")], kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in (c.as_py() for c in b.column(0)):
                part = []
                for record in read_archive(content):
                    part.append(row(record))
                    if len(part) == 256:
                        yield pa.RecordBatch.from_pylist(part, schema)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    return files.option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(read, RECORD)


def archived(pages: DataFrame, path: str | None = None, payloads: bool = False, **options) -> DataFrame:
    """Write all pages (to the shared folder, without a path) and read the archives back."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "archives")
    write_archives(pages, path, **options)
    return read_archives(spark, path, payloads)
