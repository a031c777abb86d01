"""Exact token counts and ids of whole texts by the tokenizers library (operators 8 and 9).

Tokenizer files are read on the executors from a path that is a parameter.
Both classes below keep what they know per word, as the pieces that a tokenizer
cuts a text into are independent of each other; what cannot be proven to be
independent goes through the library whole.
"""

import json
import os
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, pieces

#: Texts of more characters are encoded in overlapping chunks.
CHUNK_CHARS = 4096
#: Characters by which neighbouring chunks overlap at first.
OVERLAP_CHARS = 64
#: Words kept per Python worker, and the longest that is kept.
CACHE_WORDS = 1_000_000
LONGEST_WORD = 64


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, one thread per task, special strings handled as by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Chunk:
    """Tokens of ``text[begin:end]`` by position in the whole text.

    Positions never fall from token to token, so those that are asked for are
    found by bisection; the others are never taken out of the library.
    """

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        self.begin, self.end = begin, min(end, len(text))
        self.found = tokenizer.encode(text[begin:end], add_special_tokens=False)

    def _start(self, token: int) -> int:
        return self.found.token_to_chars(token)[0] + self.begin

    def _first(self, position: int) -> int:
        return bisect_left(range(len(self.found)), position, key=self._start)

    def boundaries(self, low: int, high: int) -> set[int]:
        """Positions from ``low`` to ``high`` at which words start."""
        out = set()
        for k in range(self._first(low), len(self.found)):
            if (at := self._start(k)) > high:
                break
            word = self.found.token_to_word(k)
            if word is not None and (k == 0 or self.found.token_to_word(k - 1) != word):
                out.add(at)
        return out

    def between(self, low: int, high: int | None = None) -> np.ndarray:
        last = None if high is None else self._first(high)
        return np.array(self.found.ids[self._first(low) : last], np.int64)


def spliced(
    tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> list[np.ndarray]:
    """Ids of a text encoded in overlapping chunks, as the library gives them for the whole.

    Two neighbours are joined at a position where a word starts in both. That is
    proven to be a boundary of the whole text too: splitting into words runs from
    left to right and depends only on the position reached, so both chunks go on
    alike from there, and what comes before it was cut by the left chunk with the
    following characters in sight. Positions within the length of a special string
    of either chunk's end are not used. Without a common position the overlap is
    doubled, up to the whole rest of the text.
    """
    margin = max(map(len, special_strings(tokenizer)), default=0) + 1
    out: list[np.ndarray] = []
    left, start = Chunk(tokenizer, text, 0, chunk + overlap), 0
    for begin in range(chunk, len(text), chunk):
        if left.end == len(text):
            break
        right = Chunk(tokenizer, text, begin, begin + chunk + overlap)
        wider = overlap
        while True:
            last = left.end - margin if left.end < len(text) else len(text)
            low = max(start, begin + margin)
            common = left.boundaries(low, last) & right.boundaries(low, last)
            if common or left.end == len(text):
                break
            wider *= 2
            left = Chunk(tokenizer, text, left.begin, begin + wider)
            if right.end < left.end:
                right = Chunk(tokenizer, text, begin, left.end)
        if not common:
            break
        out.append(left.between(start, min(common)))
        left, start = right, min(common)
    out.append(left.between(start))
    return out


def remember(known: dict, words: list, found: list) -> None:
    """Add what was found for words; starts anew when full, so that a worker's memory stays bounded."""
    if len(known) + len(words) > CACHE_WORDS:
        known.clear()
    known.update(zip(words, found, strict=True))


def _by_word(tokenizer, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words encoded in one go, and the word that each belongs to."""
    text = lead + " ".join(words)
    found = tokenizer.encode(text, add_special_tokens=False)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    at = np.array([a for a, _ in found.offsets], np.int64)
    return np.array(found.ids, np.uint32), np.searchsorted(starts, at, side="right") - 1


class TokenCounter:
    """Counts tokens with a byte-level tokenizer whose words take the blank before them.

    A position before a single blank always starts a word, unless white space
    stands on both sides of it or a special string is near: then, and with
    tokenizers of any other form, the library encodes the text whole.
    """

    _blanks = re.compile(r"\s \s")

    def __init__(self, path: str, chunk: int, overlap: int):
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.by_word = (
            spec["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and pre["use_regex"]
            and not pre["add_prefix_space"]
        )
        self.special = special_strings(self.tokenizer)
        self.known: dict = {}  # a plain one: sets leave out its keys without going through it

    def _whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        plain = [w for w in new if w and w == w.strip() and len(w) <= LONGEST_WORD]
        counts = []
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            _, place = _by_word(self.tokenizer, part, " ")
            counts += np.bincount(place, minlength=len(part)).tolist()
        odd = [w for w in new if not (w and w == w.strip() and len(w) <= LONGEST_WORD)]
        remember(self.known, plain + odd, counts + [self._whole(f" {w}") for w in odd])

    def counts(self, texts: list[bytes]) -> list[int]:
        out, split = [0] * len(texts), []
        for k, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            if len(text) > self.chunk and self.by_word:
                out[k] = sum(map(len, spliced(self.tokenizer, text, self.chunk, self.overlap)))
            elif (
                not self.by_word
                or any(s in text for s in self.special)
                or self._blanks.search(text)
            ):
                out[k] = self._whole(text)
            else:
                split.append((k, text.split(" ")))
        self._learn({w for _, words in split for w in words[1:]})
        known = self.known
        for k, words in split:
            try:
                out[k] = self._whole(words[0]) + sum(map(known.__getitem__, words[1:]))
            except KeyError:  # the cache started anew meanwhile
                out[k] = self._whole(" ".join(words))
        return out


class IdEncoder:
    """Ids from a tokenizer that drops white space and encodes each word by itself.

    Normal form, lower case and the split into words do not reach across an
    ASCII blank there, so a text's ids are those of its words in a row. Texts that hold a
    special string (in any case) and tokenizers of any other form go whole.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        self.by_word = (
            [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and "(?" not in steps[0]["pattern"].get("Regex", "(?")
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
            and {n["type"] for n in normal} <= {"NFC", "Lowercase", "Replace"}
            and [n["pattern"] for n in normal if n["type"] == "Replace"] in ([], [{"Regex": r"\s+"}])
            and any(n["type"] == "Lowercase" for n in normal)
        )
        self.special = [s.lower().encode() for s in special_strings(self.tokenizer)]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict = {}  # a plain one: sets leave out its keys without going through it

    def _whole(self, text: bytes) -> bytes:
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.known))
        short = [w for w in new if len(w) <= LONGEST_WORD]
        found = []
        for k in range(0, len(short), 4096):
            part = [w.decode("utf-8", "replace") for w in short[k : k + 4096]]
            ids, place = _by_word(self.tokenizer, part, "")
            ends = np.searchsorted(place, np.arange(len(part)), side="right") * 4
            raw = ids.astype("<u4").tobytes()
            found += [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        long = [w for w in new if len(w) > LONGEST_WORD]
        remember(self.known, short + long, found + [self._whole(w) for w in long])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        split = []
        for k, text in enumerate(texts):
            lower = text.lower()
            if not self.by_word or any(s in lower for s in self.special):
                out[k] = self._whole(text)
            else:
                split.append((k, lower.split()))
        self._learn({w for _, words in split for w in words})
        known = self.known
        for k, words in split:
            try:
                out[k] = b"".join(map(known.__getitem__, words))
            except KeyError:  # the cache started anew meanwhile
                out[k] = self._whole(texts[k])
        return out


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> TokenCounter:
    return TokenCounter(path, chunk, overlap)


@lru_cache(maxsize=4)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def n_tokens(
    text: str | Column, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> Column:
    """Tokens of a whole text by the tokenizer file at ``path``; 0 for null and empty texts."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        counting = counter(path, chunk, overlap)
        return pa.array([n for part in pieces(texts) for n in counting.counts(part)], pa.int64())

    return count(as_bytes(text))


def token_counts(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty; repeated rows and null ids stay as they are;
    columns other than the two named are not read.
    """
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(n_tokens(text_col, path, chunk, overlap), F.lit(0)).cast("long").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
