"""Counts of words, lines and symbols of whole texts, for rules and labellers.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form
feed and carriage return. A null text counts as empty; every count is then 0.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.llm.common import as_bytes, values

FIELDS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_upper",
    "n_digits",
    "n_marks",
    "n_bars",
)
SCHEMA = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">"

#: Shares that rules and labellers compare: name, counted field, field it is divided by.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "bar_share": ("n_bars", "n_words"),
    "word_length": ("word_chars", "n_words"),
}

_BLANKS = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside three-word windows found twice or more, and distinct words."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    n, distinct = len(ids), len(seen)
    if n < 4 or distinct == n:
        return 0, distinct
    code = np.array(ids, np.int64)
    if distinct < 1 << 20:
        code = (code[:-2] * distinct + code[1:-1]) * distinct + code[2:]
    else:  # three ids do not fit in 63 bits: number the pairs first
        pair = np.unique(code[:-1] * distinct + code[1:], return_inverse=True)[1]
        code = pair[:-1] * distinct + code[2:]
    _, place, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[place] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum()), distinct


def statistics(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of FIELDS."""
    words = text.split()
    if not words:
        return (0,) * len(FIELDS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeats, distinct = repeated_words(words)
    return (
        len(words),
        len(text.translate(None, _BLANKS + _CONTINUED)),
        _count(text, b"#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        distinct,
        _count(text, _UPPER),
        _count(text, b"0123456789"),
        _count(text, b"!?"),
        text.count(b"|"),
    )


def _statistics(text: pa.Array) -> pa.Array:
    rows = np.array([statistics(t) for t in values(text)], np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], names=list(FIELDS))


def text_statistics(text: str | Column) -> Column:
    """Struct of all counts of a text column."""
    return F.arrow_udf(_statistics, SCHEMA)(as_bytes(text))


def share(stats: str, name: str) -> Column:
    """A share out of a statistics column; 0 where there is nothing to divide by."""
    top, below = SHARES[name]
    whole = F.col(f"{stats}.{below}")
    return F.when(whole > 0, F.col(f"{stats}.{top}") / whole).otherwise(0.0)


def measures(stats: str) -> dict[str, Column]:
    """All that rules may compare, by name."""
    return {"n_words": F.col(f"{stats}.n_words").cast("double")} | {
        name: share(stats, name) for name in SHARES
    }
