"""Benchmark passages in documents by the q-gram lemma (operator 6).

Texts are compared as bytes, with A-Z in lower case and runs of white space as one blank.
Benchmark items are cut into overlapping windows. A window of m bytes that
stands in a text with at most k edits shares at least m + 1 - q * (k + 1) of its
q-grams with it, all within k + 1 neighbouring diagonals (place in the text less
place in the item). So shared q-grams are counted in overlapping bands of
diagonals, bands that reach the bound are kept, and a banded alignment decides.

Items too short for the lemma are found by equality, between ends of words. Where
an item repeats up to 64 bytes over and over, as drawn lines do, items and documents
are compared with such stretches cut to 64 bytes beyond the first repetition.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, fresh, values

#: Bytes in a q-gram, and in a window; edits allowed for a byte of window.
Q, WINDOW, EDITS = 12, 128, 0.06
#: Items of fewer bytes are searched for without edits.
LEAST_BYTES = 40
#: Longest repeated piece, and the bytes that its repetitions are cut to.
PERIOD = 64
#: Shared q-grams that are looked at together; a text with more is halved.
HITS = 1 << 22
#: Bytes of benchmark that one index is made of; more make further rounds over the documents.
INDEX_BYTES = 8 << 20
#: Bytes of text that are looked at together.
RUN_BYTES = 2 << 20
#: Diagonals that a band has beyond the edits.
BAND = 16

_SHIFT = np.uint64(64 - 22)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r\x00", b"abcdefghijklmnopqrstuvwxyz      "
)

FOUND = "array<struct<item_id:bigint,start:int,stop:int,edits:int,windows:int>>"
_FOUND = pa.list_(
    pa.struct(
        [("item_id", pa.int64())] + [(n, pa.int32()) for n in ("start", "stop", "edits", "windows")]
    )
)


#: From this code point on are scripts that are written without blanks (the first is Thai).
_UNSPACED = "\u0e00"
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _grams(data: bytes) -> np.ndarray:
    """A number for the q-gram at each place; equal q-grams have equal numbers."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    first = np.ndarray((n,), "<u8", data, 0, (1,))
    last = np.ndarray((n,), "<u8", data, Q - 8, (1,))
    return first * _MIX[0] ^ last * _MIX[1]


@dataclass
class Index:
    """Q-grams of some items, sorted, and their windows; and the items that are too short for that."""

    ids: list[int | None]  # of the items in ``texts``, then of the short ones
    texts: list[bytes]
    short: dict[int, np.ndarray]  # for each length the numbers of the short items' texts, sorted
    same: dict[bytes, list[int]]  # short text: places in ``ids``
    periods: list[int]  # lengths of pieces that any item repeats
    maybe: np.ndarray  # by the upper bits of a q-gram's number: whether any item has such
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    budget: np.ndarray  # most edits of any window of an item
    bound: np.ndarray  # fewest shared q-grams that any window of an item needs
    edits: float


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping stretches of an item of ``n`` bytes."""
    if n <= WINDOW:
        return [(0, n)]
    return [(s, s + WINDOW) for s in range(0, n - WINDOW, WINDOW // 2)] + [(n - WINDOW, n)]


def needed(m: int, edits: float) -> int:
    """Q-grams that a window of ``m`` bytes shares with any place it stands in within its edits."""
    return max(1, m + 1 - Q * (int(edits * m) + 1))


def normal(text: bytes) -> bytes:
    return text.translate(_LOWER)


def repeated(data: np.ndarray, period: int) -> np.ndarray:
    """Whether a byte, and the PERIOD bytes before it, equal those ``period`` places before; zero bytes part texts."""
    same = np.zeros(len(data), bool)
    same[period:] = (data[period:] == data[:-period]) & (data[period:] != 0)
    place = np.arange(len(data))
    return place - np.maximum.accumulate(np.where(same, -1, place)) > PERIOD


def joined(texts: list[bytes], periods: list[int] = ()) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts with a zero byte after each, runs of white space as one blank, repetitions of
    ``periods`` bytes cut, and two arrays: where each byte stood before, and where each text started."""
    data = np.frombuffer(b"\0".join(map(normal, texts)) + b"\0", np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    blank = data == 32
    blank[1:] &= blank[:-1].copy()
    blank[0] = False
    places = np.flatnonzero(~blank)
    for period in periods:
        places = places[~repeated(data[places], period)]
    return data[places].tobytes(), places, starts


def _numbers(data: bytes, at: np.ndarray, m: int) -> np.ndarray:
    """A number for the ``m`` bytes at each of some places; equal bytes have equal numbers."""
    eight = np.ndarray((len(data),), "<u8", data + bytes(8), 0, (1,))
    if m < 8:
        return eight[at] & np.uint64((1 << 8 * m) - 1)
    return eight[at] * _MIX[0] ^ eight[at + (m - 8)] * _MIX[1]


def build(items: list[tuple[int | None, bytes]], edits: float = EDITS, least_bytes: int = 1) -> Index:
    """Index of (id, text) items; blanks around an item don't count, and blank items are left out.

    So are items of fewer than ``least_bytes`` bytes. ``edits`` must be low enough for the lemma.
    """
    if any(m + 1 <= Q * (int(edits * m) + 1) for m in range(LEAST_BYTES, WINDOW + 1)):
        raise ValueError(f"texts with {edits} edits a byte need not share a {Q}-gram")
    every = [(i, b" ".join(normal(t).split())) for i, t in items]
    every = [(i, t) for i, t in every if len(t) >= max(1, least_bytes)]
    data = np.frombuffer(b"".join(t + b"\0" for _, t in every), np.uint8)
    periods = []
    for period in range(1, PERIOD + 1):
        cut = repeated(data, period)
        if cut.any():
            periods.append(period)
            data = data[~cut]
    every = list(zip([i for i, _ in every], data.tobytes().split(b"\0")[:-1], strict=True))
    kept = [(i, t) for i, t in every if len(t) >= LEAST_BYTES]
    brief = [(i, t) for i, t in every if len(t) < LEAST_BYTES]
    same: dict[bytes, list[int]] = {}
    for k, (_, t) in enumerate(brief, len(kept)):
        same.setdefault(t, []).append(k)
    short = {
        m: np.unique(np.concatenate([_numbers(t, np.zeros(1, int), m) for t in same if len(t) == m]))
        for m in sorted({len(t) for t in same})
    }
    grams = [_grams(t) for _, t in kept]
    sizes = [len(g) for g in grams]
    flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(kept)), sizes)
    place = np.concatenate([*(np.arange(s) for s in sizes), np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    maybe = np.zeros(1 << 22, bool)
    maybe[flat >> _SHIFT] = True
    ids, texts = [i for i, _ in kept + brief], [t for _, t in kept]
    longest = [min(len(t), WINDOW) for t in texts]
    budget = np.array([int(edits * m) for m in longest], np.int64)
    bound = np.array([needed(m, edits) for m in longest], np.int64)
    return Index(ids, texts, short, same, periods, maybe, flat[order], item[order], place[order], budget, bound, edits)


def _shared(index: Index, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the text of q-grams that items have, and the first and number of each in the index."""
    grams = _grams(data)
    at = np.flatnonzero(index.maybe[grams >> _SHIFT])
    low = np.searchsorted(index.grams, grams[at], "left")
    count = np.searchsorted(index.grams, grams[at], "right") - low
    return at[count > 0], low[count > 0], count[count > 0]


def _hits(index: Index, at: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the text, items, and places in the items of all shared q-grams."""
    which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(at, count), index.item[which], index.place[which]


def _bands(index: Index, item: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int]]:
    """(item, band) with as many hits as a window of the item needs at least.

    Band j spans the diagonals from j * BAND to BAND - 1 + k further, so neighbours
    overlap by k and any k + 1 neighbouring diagonals lie in one band.
    """
    top, most = diagonal // BAND, int(index.budget.max(initial=0))
    lowest = (diagonal - index.budget[item]) // BAND
    keys = []
    for back in range(most // BAND + 2):
        reach = top - back >= lowest
        keys.append((item[reach] << 40) + (top - back)[reach] + (1 << 39))
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    keys = keys[counts >= index.bound[keys >> 40]]
    return [(k >> 40, (k & (1 << 40) - 1) - (1 << 39)) for k in keys.tolist()]


def _candidates(index: Index, shared: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(item, window start, window end, lowest diagonal) of bands that reach a window's bound."""
    at, item, place = _hits(index, *shared)
    if not len(at):
        return []
    order = np.argsort((item << 40) + (at - place) + (1 << 39), kind="stable")
    item, place, diagonal = item[order], place[order], (at - place)[order]
    sorted_by = (item << 40) + diagonal + (1 << 39)
    found = []
    for i, j in _bands(index, item, diagonal):
        first = (i << 40) + j * BAND + (1 << 39)
        a, b = np.searchsorted(sorted_by, [first, first + BAND + int(index.budget[i])])
        own = place[a:b]
        for low, high in windows(len(index.texts[i])):
            inside = np.count_nonzero((own >= low) & (own <= high - Q))
            if inside >= needed(high - low, index.edits):
                found.append((i, low, high, j * BAND))
    return found


def align(window: bytes, data: bytes, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Least edits of ``window`` anywhere on the diagonals from ``low`` to ``high`` of ``data``,
    and the end of the first such place; nothing beyond ``most`` edits.

    Row r of the band holds the text places r + low to r + high. Bytes outside
    the text fit nothing.
    """
    wide, far = high - low + 1, 1 << 20
    text = np.full(len(window) + wide, -1, np.int16)
    a, b = max(0, low), min(len(data), low + len(text))
    if b > a:
        text[a - low : b - low] = np.frombuffer(data, np.uint8, b - a, a)
    step = np.arange(wide)
    row = np.zeros(wide, np.int64)
    for r, c in enumerate(window):
        new = row + (text[r : r + wide] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
        if row.min() > most:
            return None
    end = int(row.argmin())
    return (int(row[end]), len(window) + low + end) if row[end] <= most else None


def _find(index: Index, data: bytes) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of windows found, in bytes.

    ``data`` may be several texts with zero bytes between them, which fit nothing. Data
    with very many shared q-grams is halved, so that they are never held together;
    the halves overlap by more than a window, and a finding is of the half it starts in.
    """
    shared = _shared(index, data)
    if shared[2].sum() > HITS and len(data) > 16 * WINDOW:
        half, lap = len(data) // 2 // BAND * BAND, 4 * WINDOW
        left = [f for f in _find(index, data[: half + lap]) if f[1] < half]
        right = _find(index, data[half - lap :])
        return left + [(i, a + half - lap, b + half - lap, n) for i, a, b, n in right if a >= lap]
    found = set()
    for item, low, high, band in _candidates(index, shared):
        m = high - low
        k = int(index.edits * m)
        window = index.texts[item][low:high]
        # Diagonals are of the item; with the window's start added they are of the window.
        got = align(window, data, band + low - k, band + low + BAND + 2 * k, k)
        if got is None:
            continue
        edits, end = got
        lead = data[max(0, end - m - k) : end]
        back = align(window[::-1], lead[::-1], -k, k, k)
        found.add((item, end - (back[1] if back else m), end, edits))
    return sorted(found)


def _in_word(data: bytes, place: int) -> bool:
    """Whether letters or digits stand before and after ``place``, in a script that has blanks."""
    before = data[max(0, place - 4) : place].decode("utf-8", "ignore")[-1:]
    after = data[place : place + 4].decode("utf-8", "ignore")[:1]
    return before.isalnum() and after.isalnum() and max(before, after) < _UNSPACED


def _short(index: Index, data: bytes) -> list[tuple[int, int, int, int]]:
    """(item, start, end, 0) of all places where a short item stands between ends of words."""
    if not index.short:
        return []
    word = _WORD[np.frombuffer(data, np.uint8)]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~(word[1:] & word[:-1])
    starts, found = np.flatnonzero(edge), []
    for m, known in index.short.items():
        at = starts[starts <= len(data) - m]
        at = at[edge[at + m]]
        numbers = _numbers(data, at, m)
        near = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
        for start in at[known[near] == numbers].tolist():
            items = index.same.get(data[start : start + m], ())
            if items and not _in_word(data, start) and not _in_word(data, start + m):
                found += [(item, start, start + m, 0) for item in items]
    return found


def search(index: Index, texts: list[bytes]) -> list[list[dict]]:
    """For each text the items found, with code points from ``start`` to before ``stop``.

    Windows of an item that overlap in the text are one finding.
    """
    out: list[list[dict]] = []
    data, at, starts = joined(texts, index.periods)
    places = [
        (int(np.searchsorted(starts, at[(start + end) // 2], "right")) - 1, item, start, end, edits)
        for item, start, end, edits in (
            (item, max(0, start), min(len(data), end), edits)
            for item, start, end, edits in _find(index, data) + _short(index, data)
        )
    ]
    merged: list[list[int]] = []
    for own, item, start, end, edits in sorted(places):
        last = merged[-1] if merged else None
        if last and last[:2] == [own, item] and start <= last[3]:
            last[3] = max(last[3], end)
            last[4] += edits
            last[5] += 1
        else:
            merged.append([own, item, start, end, edits, 1])
    out = [[] for _ in texts]
    for own, item, start, end, edits, n in merged:
        # An end is where the last byte stood, and one on.
        cut = [max(0, int(x - starts[own])) for x in (at[start], at[end - 1] + 1)]
        first, stop = (len(texts[own][:x].decode("utf-8", "ignore")) for x in cut)
        names = ("item_id", "start", "stop", "edits", "windows")
        out[own].append(dict(zip(names, (index.ids[item], first, stop, edits, n), strict=True)))
    return out


def indexes(
    benchmark: DataFrame, id_col: str, text_col: str, edits: float, index_bytes: int, least_bytes: int = 1
) -> list[Index]:
    """Indexes of all items, each of about ``index_bytes`` of them at most; none for an empty table.

    Items without a text are left out; repeated rows count once. An item may have no id.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    items = items.filter("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    rounds = -(-total * 5 // (index_bytes * 4)) if total > index_bytes else 1
    found = []
    for k in range(rounds):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == k) if rounds > 1 else items
        rows = [(r["i"], bytes(r["t"])) for r in part.toLocalIterator()]
        found.append(build(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), edits, least_bytes))
    return [x for x in found if x.ids]


def finder(spark, index: Index):
    """Function that gives a column of items found in a text column."""
    shared = spark.sparkContext.broadcast(index)  # bounded by index_bytes

    def run(texts: pa.Array) -> pa.Array:
        found, part, size = [], [], 0
        for text in values(texts):
            part.append(text)
            size += len(text)
            if size >= RUN_BYTES:
                found += search(shared.value, part)
                part, size = [], 0
        if part:
            found += search(shared.value, part)
        return pa.array(found, _FOUND)

    return lambda text: F.arrow_udf(run, FOUND)(as_bytes(text))


def found_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    edits: float = EDITS,
    index_bytes: int = INDEX_BYTES,
    least_bytes: int = 1,
) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned too: the items found in each text.

    There is a search for each ``index_bytes`` of benchmark; documents are not
    shuffled. Null and empty texts hold nothing; all rows stay. An item without an id is found
    with a null item_id. An item of one word is found wherever the word is: where a
    benchmark has such items, ``least_bytes`` can leave them out.
    """
    out = fresh(docs, "items_found")
    found = [
        finder(docs.sparkSession, index)(text_col)
        for index in indexes(benchmark, item_id_col, item_text_col, edits, index_bytes, least_bytes)
    ]
    if not found:
        return docs.withColumn(out, F.array().cast(FOUND)), out
    return docs.withColumn(out, F.concat(*found) if len(found) > 1 else found[0]), out


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per passage found: doc_id, item_id, start, stop (code points), edits, windows."""
    docs, out = found_items(docs, benchmark, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(out).alias("found"))
    return rows.select("doc_id", "found.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in whose text no item was found."""
    found, out = found_items(docs, benchmark, **options)
    return found.filter(F.size(out) == 0).drop(out)
