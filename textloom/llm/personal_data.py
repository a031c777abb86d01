"""Personal data in texts, with built-in functions only (operator 7).

Regular expressions propose spans, checksums and ranges confirm them, and context
words nearby adjust the score of those that are not sure by themselves. Patterns
use possessive repeats and look behind for the start of a run, so that a text of
any length is read in linear time, and match what their plain forms match.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base patterns. The plain forms, which give the same spans after the checks:
#: email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card   [0-9]([\x20-]?[0-9])+ with 12 to 19 digits
#: phone  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_HINTS = {
    "email": ("contains", "@"),
    "ip": ("rlike", r"[0-9]\.[0-9]"),
    "card": ("rlike", r"[0-9](?:[\x20-]?+[0-9]){11}"),
    "phone": ("contains", "+"),
    "iban": ("rlike", r"[A-Z]{2}[0-9]{2}"),
    "phone_words": ("rlike", r"[0-9]{3}[\x20.)-]"),
    "ssn": ("rlike", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Further patterns: kind, pattern, score, words nearby and what they add. That of
#: account numbers is their start only; ``account_numbers`` finds where they end.
FURTHER = {
    "iban": (
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?+[A-Z0-9]){11})",
        0.8,
        r"iban|account|konto|compte|cuenta|bank",
        0.2,
    ),
    "phone_words": (
        "phone",
        r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
        0.3,
        r"phone|call|tel|mobile|fax|telefon|téléphone|teléfono",
        0.4,
    ),
    "ssn": (
        "ssn",
        r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
        0.3,
        r"ssn|social security",
        0.5,
    ),
}
#: Score from which a further span counts, and characters before and after that are its context.
LEAST_SCORE, CONTEXT = 0.5, 40
#: Fewest characters from a match of a further pattern to the next one.
LEAST_MATCH = {"iban": 5, "phone_words": 11, "ssn": 11}
#: What may go on from an account number's start: as much as fits, and a character that doesn't.
_REST, _REST_CHARS = r"^(?:\x20?+[A-Z0-9]){11,30}+[A-Za-z0-9]?", 61
_ACCOUNT = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}$"

_SPAN = "array<struct<start:bigint,kind_no:int,stop:bigint,kind:string,score:double>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _scan(numbers: Column) -> Column:
    """Sums up to and with each number of a short array."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("all"))

    def add(held: Column, x: Column) -> Column:
        s = held["s"] + x
        return F.struct(s.alias("s"), F.concat(held["all"], F.array(s)).alias("all"))

    return F.aggregate(numbers, start, add, lambda held: held["all"])


def running_sums(numbers: Column) -> Column:
    """Sums up to and with each number, by stretches of about the square root of their count."""
    zero = F.lit(0).cast("long")

    def sums(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        places = F.sequence(F.lit(0), F.ceil(F.size(v) / step).cast("int") - 1)
        part = lambda k: F.slice(v, k * step + 1, step)
        totals = F.transform(places, lambda k: F.aggregate(part(k), zero, lambda a, x: a + x))
        moved = lambda k, by: F.transform(_scan(part(k)), lambda x: x + by)
        return let(
            F.concat(F.array(zero), _scan(totals)),
            lambda before: F.flatten(
                F.transform(places, lambda k: let(F.get(before, k), lambda by: moved(k, by)))
            ),
        )

    none = F.array().cast("array<bigint>")
    return let(numbers, lambda v: F.when(F.size(v) > 0, sums(v)).otherwise(none))


def _around(
    found: Column, between: Column, k: Column, before: int, after: int, least: int
) -> tuple[Column, Column]:
    """Up to so many characters of the text before and after match ``k``, other matches included.

    Each match with the text up to the next has ``least`` characters at least, so
    few neighbours fill a side, and a match costs the same however many there are.
    """
    n = F.size(found)

    def pair(j: Column) -> Column:
        text = F.coalesce(F.get(between, j), F.lit(""))
        return F.concat(F.right(text, F.lit(before)), F.get(found, j))

    def next_pair(j: Column) -> Column:
        text = F.coalesce(F.get(between, j + 1), F.lit(""))
        return F.concat(F.get(found, j), F.left(text, F.lit(after)))

    back, on = -(-before // least), -(-after // least)
    none = F.array().cast("array<int>")
    earlier = F.when(k > 0, F.sequence(F.greatest(k - back, F.lit(0)), k - 1)).otherwise(none)
    later = F.when(k < n - 1, F.sequence(k + 1, F.least(k + on, n - 1))).otherwise(none)
    ahead = F.concat(F.array_join(F.transform(earlier, pair), ""), F.right(F.get(between, k), F.lit(before)))
    behind = F.concat(F.left(F.get(between, k + 1), F.lit(after)), F.array_join(F.transform(later, next_pair), ""))
    return F.right(ahead, F.lit(before)), F.left(behind, F.lit(after))


def proposals(
    text: Column, pattern: str, hint: tuple[str, str], after: int | None = None, least: int = 1
) -> Column:
    """Matches as (start, stop, value), in code points, leftmost and without overlap.

    The text between matches and the matches themselves, in turns, give the places.
    With ``after`` they also have ``before``, up to CONTEXT characters of the text
    before the match, and ``after``, up to so many behind it; matches start ``least``
    characters apart or more.
    """

    def spans(found: Column, between: Column) -> Column:
        n = F.size(found)
        sizes = F.zip_with(
            F.slice(between, 1, n), found, lambda a, b: F.length(a).cast("long") + F.length(b)
        )
        fields = lambda value, stop: (
            (stop - F.length(value)).alias("start"), stop.alias("stop"), value.alias("value")
        )
        placed = F.zip_with(found, running_sums(sizes), lambda value, stop: F.struct(*fields(value, stop)))
        if after is None:
            return placed

        def with_context(s: Column, k: Column) -> Column:
            ahead, behind = _around(found, between, k, CONTEXT, after, least)
            return F.struct(
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                s["value"].alias("value"),
                ahead.alias("before"),
                behind.alias("after"),
            )

        return F.transform(placed, with_context)

    more = "" if after is None else ",before:string,after:string"
    none = F.array().cast(f"array<struct<start:bigint,stop:bigint,value:string{more}>>")
    kind, what = hint
    there = F.contains(text, F.lit(what)) if kind == "contains" else F.rlike(text, F.lit(what))
    matched = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(
            F.size(found) > 0, let(F.split(text, pattern, -1), lambda between: spans(found, between))
        ).otherwise(none),
    )
    return F.when(there, matched).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    """Whether digits are a number of at most 255."""
    plain = F.regexp_replace(part, "^0+", "")
    short = F.length(plain) <= 3
    return short & (F.coalesce(F.when(short, plain).try_cast("int"), F.lit(0)) <= 255)


def mod97(value: Column) -> Column:
    """Whether an account number's check digits are right: letters count 10 to 35, rest 1 by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(held: Column, c: Column) -> Column:
        code = F.ascii(c)
        digit = code < 65
        return F.when(digit, (held * 10 + code - 48) % 97).otherwise((held * 100 + code - 55) % 97)

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """What a checksum, a range or a count of digits says of a proposal."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


def account_numbers(found: Column) -> Column:
    """Account numbers from their proposed starts: the longest run of whole groups with right check digits.

    What follows a number, such as a capitalised word, another number or a bank's
    code, may look like more groups of it, so each end of a group is tried. A
    number that starts inside an earlier one is left out.
    """

    def ends(s: Column) -> Column:
        rest = F.regexp_extract(s["after"], _REST, 0)
        runs = let(
            F.split(F.concat(s["value"], rest), " "),
            lambda groups: F.transform(
                F.sequence(F.lit(1), F.size(groups)), lambda j: F.array_join(F.slice(groups, 1, j), " ")
            ),
        )
        right = F.filter(runs, lambda r: F.rlike(r, F.lit(_ACCOUNT)) & confirmed("iban", r))
        return let(right, lambda r: F.get(r, F.size(r) - 1))

    def whole(s: Column, value: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            (s["start"] + F.length(value)).alias("stop"),
            value.alias("value"),
            s["before"].alias("before"),
            F.substr(s["after"], F.length(value) - F.length(s["value"]) + 1, F.lit(CONTEXT)).alias("after"),
        )

    placed = F.transform(found, lambda s: let(ends(s), lambda value: whole(s, value)))
    # A number has 64 characters at most, and starts are 5 apart.
    earlier = lambda all_, k: F.slice(all_, F.greatest(k - 13, F.lit(0)) + 1, F.least(k, F.lit(13)))
    return let(
        F.filter(placed, lambda s: s["value"].isNotNull()),
        lambda right: F.filter(right, lambda s, k: ~F.exists(earlier(right, k), lambda e: e["stop"] > s["start"])),
    )


def _spans(found: Column, kind: str, score) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind_no"),
            s["stop"].alias("stop"),
            F.lit(kind).alias("kind"),
            score(s).alias("score"),
        ),
    )


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(proposals(text, BASE[kind], _HINTS[kind]), lambda s: confirmed(kind, s["value"]))
    return _spans(found, kind, lambda s: F.lit(1.0))


def further_spans(text: Column, name: str) -> Column:
    """Spans whose score, with that of words nearby, is enough."""
    kind, pattern, score, words, more = FURTHER[name]

    def scored(s: Column) -> Column:
        near = F.concat(s["before"], s["value"], s["after"])
        bonus = F.when(F.rlike(F.lower(near), F.lit(words)), more).otherwise(0.0)
        return F.least(F.lit(score) + bonus, F.lit(1.0))

    after = CONTEXT + _REST_CHARS * (kind == "iban")
    found = proposals(text, pattern, _HINTS[name], after, LEAST_MATCH[name])
    found = account_numbers(found) if kind == "iban" else F.filter(found, lambda s: confirmed(kind, s["value"]))
    return F.filter(_spans(found, kind, scored), lambda s: s["score"] >= LEAST_SCORE)


def find(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, whose names are returned too: base spans and all spans.

    Both are arrays of (start, kind_no, stop, kind, score) in order of start,
    then kind. Base spans are kept whatever else is found; further ones that
    overlap a base span are left out. A null text is empty; all rows stay, and
    nothing is shuffled.
    """
    text, base, every = fresh(docs, "text_found"), fresh(docs, "base_spans"), fresh(docs, "all_spans")
    found = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    kept = F.concat(*(base_spans(F.col(text), k) for k in BASE))
    found = found.withColumn(base, F.array_sort(kept))
    more = F.concat(*(further_spans(F.col(text), k) for k in FURTHER))
    apart = lambda s: ~F.exists(
        F.col(base), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])
    )
    found = found.withColumn(every, F.filter(more, apart))
    joined = F.when(F.size(every) > 0, F.array_sort(F.concat(base, every))).otherwise(F.col(base))
    return found.withColumn(every, joined).drop(text), base, every


def as_text(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    colon = F.lit(":")
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(s["kind"], colon, s["start"].cast("string"), colon, s["stop"].cast("string")),
        ),
        ",",
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, SHA-256 of the base spans, and all spans as text."""
    found, base, every = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return found.select(
        "doc_id",
        *(count_of(F.col(base), k).alias(f"n_{k}") for k in BASE),
        F.sha2(as_text(F.col(base)), 256).alias("base_sha256"),
        as_text(F.col(every)).alias("spans"),
    )
