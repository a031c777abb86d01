"""WARC archives: round trips, damage, and revisits against plain Python."""

import base64
import hashlib

import pytest
import zstandard

from textloom.llm import queries, warc
from textloom.session import new_folder


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive(records, held=b""):
    compressor = zstandard.ZstdCompressor(dict_data=warc._with_dictionary(held), write_checksum=True)
    frames = [warc.skippable(warc._DICTIONARY, held)]
    for r in records:
        frames += [warc._AFTER_ROW, compressor.compress(r)]
    return b"".join(frames)


def response(k, payload):
    return warc.record_bytes(k, f"http://e.org/{k}", hashlib.sha1(payload).digest(), len(payload), payload, None)


PAYLOADS = [b"", b"x", b"\r\n\r\n", b"html " * 5000, bytes(range(256)) * 2000]
RECORDS = [response(k, p) for k, p in enumerate(PAYLOADS)]


@pytest.mark.parametrize("held", [b"", b"html HTTP/1.1 200 OK" * 20, warc.dictionary(RECORDS * 40)])
def test_round_trip(held):
    for stored in (held, zstandard.compress(held) if held else held):
        compressor = zstandard.ZstdCompressor(dict_data=warc._with_dictionary(held))
        data = warc.skippable(warc._DICTIONARY, stored) + b"".join(map(compressor.compress, RECORDS))
        assert [r.payload for r in warc.read_archive(data)] == PAYLOADS


def test_other_readers_pass_over_the_skippable_frames():
    data = archive(RECORDS)
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    assert reader.read() == b"".join(RECORDS)


@pytest.mark.parametrize("cut", [1, 5, 40])
def test_cut_archives_are_refused(cut):
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(archive(RECORDS)[:-cut]))


def test_damaged_archives_are_refused():
    data = bytearray(archive([RECORDS[3]]))
    data[-2] ^= 255  # the frame's checksum
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(bytes(data)))
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(b"WARC/1.1\r\n"))


@pytest.mark.parametrize(
    "change",
    [
        (b"WARC/1.1", b"WARC/3.0"),
        (b"WARC-Type: response\r\n", b""),
        (b"WARC-Date", b"WARC-Day"),
        (b"\r\nContent-Length: ", b"\r\nContent-Length: 9"),
        (b"WARC-Record-ID:", b"WARC-Record-ID"),
        (b"sha1:", b"sha1:A"),
    ],
)
def test_bad_records_are_refused(change):
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(archive([RECORDS[1].replace(*change, 1)])))


def plain(rows, least=0):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        again = len(p) >= least and p in first and first[p] != i
        out.append((i, len(p), digest(p), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=repr)


def result(found):
    return sorted(
        (tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
        key=repr,
    )


ODD = [
    (3, "http://a.org/\r\nEvil: 1", "same"),
    (2, None, "same"),
    (2, "http://twice.org", "same"),
    (None, "http://none.org", "same"),
    (None, "x", "alone"),
    (None, "y", "alone"),
    (5, "ü://é.org/ b", None),
    (4, "", ""),
    (9, "http://big.org", "long é " * 60_000),
    (8, "http://crlf.org", "a\r\n\r\nb\nWARC/1.1\r\n"),
]


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_odd_rows(spark, least):
    pages = spark.createDataFrame(
        [(*r, "z", 1) for r in ODD], "page_id long, url string, html string, digest string, first int"
    )
    assert result(warc.archived(pages, least=least)) == plain(ODD, least)
    assert warc.archived(pages.limit(0)).count() == 0


def test_payloads_and_urls_come_back(spark):
    rows = [(k, f"http://p.org/{k}?q=%20", f"page {k} " * (k * 40)) for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.archived(pages, payloads=True).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in found) == rows


def test_small_archives(spark):
    rows = [(k, "u", f"{hashlib.sha256(str(k).encode()).hexdigest() * 200}") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = new_folder(spark, "small")
    warc.write_archives(pages, path, archive_bytes=1000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    assert files.count() > 1
    for r in files.collect():
        assert int.from_bytes(r.content[:4], "little") == warc._DICTIONARY
    assert result(warc.read_archives(spark, path)) == plain(rows)


def test_query_against_plain_python(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(queries.op4_warc(spark, folder)) == plain(rows)
