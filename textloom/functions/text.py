"""Text expressions.  All of them are built-in Spark functions; none needs Python workers."""

import re
import sys
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from textloom import fixed

_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
DIGITS = "".join(_DIGITS)
AS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

SPACES = "".join(chr(c) for a, b in fixed.WHITESPACE_RANGES for c in range(a, b + 1))
SPACE_CLASS = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in fixed.WHITESPACE_RANGES)
# The same class for Java's regexes, which here tell a printable ASCII character by one look
SPACE = f"[[^!-~]&&[{SPACE_CLASS}]]"


def strip(text: Column) -> Column:
    """Drop every kind of Unicode space from both ends; ``trim`` alone knows only the blank."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def tokens(text: Column) -> Column:
    """Distinct lower-cased words between spaces; empty for a blank text.

    Every kind of space becomes a blank first, as splitting at one character needs no regex.
    """
    words = F.split(F.translate(F.lower(text), SPACES, " " * len(SPACES)), " ")
    return F.array_remove(F.array_distinct(words), "")


def fill(form: str, **parts: Column) -> Column:
    """``form`` with each {name} replaced by the column of that name."""
    pieces = [
        parts[p[1:-1]] if p.startswith("{") and p[1:-1] in parts else F.lit(p)
        for p in re.split(r"(\{[a-z]+\})", form)
        if p
    ]
    return F.concat(*pieces)


def render(template: Column, text: Column, hole: str = "{user_text}") -> Column:
    """Put the text into the template.  Braces in the text stay as they are."""
    return F.replace(template, F.lit(hole), text)


def replace_all(text: Column, tags: Mapping[str, str] = fixed.SYMBOL_TAGS) -> Column:
    """Replace each symbol by its tag, one symbol after the other."""
    for symbol, tag in tags.items():
        text = F.replace(text, F.lit(symbol), F.lit(tag))
    return text


def char_share(text: Column, char_class: str = fixed.CHINESE_CLASS) -> Column:
    """Share of the characters that belong to a regex class; null for an empty text."""
    kept = F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))
    total = F.length(text)
    return F.when(total > 0, kept.cast("double") / total.cast("double"))


def cut_at_terminator(text: Column, terminator: str = fixed.TERMINATOR) -> Column:
    """The lines before the first line that is the terminator, stripped as one text."""
    end = terminator.lower()
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda line: strip(F.lower(line))), end)
    kept = F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines)
    return F.when(F.contains(F.lower(text), F.lit(end)), strip(F.array_join(kept, "\n"))).otherwise(
        strip(text)
    )


# ---- names and keys


def display_name(name: Column, id_: Column) -> Column:
    """The name, or the id when there is no name or an empty one."""
    return F.coalesce(F.nullif(name, F.lit("")), id_)


def composite_key(provider: Column, name: Column) -> Column:
    return F.concat(provider, F.lit("/"), name)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def key_group(key: Column, unknown: str = fixed.UNKNOWN_PROVIDER) -> Column:
    """What stands before the first slash, or ``unknown`` without a slash."""
    return F.when(F.contains(key, F.lit("/")), F.substring_index(key, "/", 1)).otherwise(unknown)


def key_name(key: Column) -> Column:
    """What stands after the first slash; the whole key without a slash."""
    slash = F.instr(key, "/")
    return F.when(slash > 0, F.substr(key, slash + 1)).otherwise(key)


def group_label(group: Column, names: Mapping[str, str] = fixed.DISPLAY_NAMES) -> Column:
    """Name to show: a listed one, else first letter upper and the rest lower."""
    label = F.concat(F.upper(F.substring(group, 1, 1)), F.lower(F.substr(group, F.lit(2))))
    for name, shown in names.items():
        label = F.when(F.lower(group) == name, shown).otherwise(label)
    return label


def group_label_web(group: Column) -> Column:
    """Only the first letter changes."""
    return F.concat(F.upper(F.substring(group, 1, 1)), F.substr(group, F.lit(2)))


def short_label(name: Column) -> Column:
    """What stands before the first opening parenthesis."""
    return strip(F.substring_index(name, "(", 1))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, to one decimal."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(micros.cast("double") / F.lit(1e6), 1)


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits, of any script, count as whole numbers of any length.

    One struct per run of (text, digits).  Numbers without leading zeros
    compare first by their length and then digit by digit.
    """
    plain = F.translate(F.lower(text), DIGITS, AS_ASCII)
    runs = F.regexp_extract_all(plain, F.lit("([^0-9]*[0-9]*)"), F.lit(1))

    def part(run: Column) -> Column:
        letters = F.regexp_replace(run, "[0-9]+$", "")
        digits = F.substr(run, F.length(letters) + 1)
        number = F.ltrim(digits, F.lit("0"))
        number = F.when((number == "") & (digits != ""), "0").otherwise(number)
        return F.struct(
            letters.alias("text"), F.length(number).alias("size"), number.alias("number")
        )

    return F.transform(F.filter(runs, lambda r: r != ""), part)


# ---- predicates


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """First keyword of the list found anywhere in the lower-cased text, else null."""
    if not keywords:
        return F.lit(None).cast("string")
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords])


def has_any(text: Column, keywords: Sequence[str]) -> Column:
    """One pass over the text for the whole list; use when the keyword itself is not wanted."""
    if not keywords:
        return F.lit(False)
    return F.rlike(F.lower(text), F.lit("|".join(f"\\Q{k.lower()}\\E" for k in keywords)))


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | F.startswith(low, F.lit(prefix))
    return hit


def null_or_contains(values: Column, wanted: str) -> Column:
    """True when the list is not given at all, or holds the value."""
    return values.isNull() | F.coalesce(F.array_contains(values, wanted), F.lit(False))


def snapshot_date(id_: Column, pattern: str = fixed.DATE_SUFFIX) -> Column:
    """Date of a dated id as text; empty for an undated one."""
    return F.regexp_extract(id_, pattern, 1)


def snapshot_base(id_: Column, pattern: str = fixed.DATE_SUFFIX) -> Column:
    return F.regexp_replace(id_, pattern, "")
