"""From language to direction, task and prompt."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textloom import fixed
from textloom.functions import text as T
from textloom.operators.lookup import lookup_join


def _common_words(clean: Column, words: Sequence[str]) -> Column:
    """How many of the words a text holds, as far as that matters.

    When a single word already earns the whole bonus, the search ends at the
    first one instead of splitting the text.
    """
    if not words:
        return F.lit(0)
    if 1 / fixed.WORDS_DIVISOR >= fixed.MAX_PATTERN_BONUS:
        any_word = "|".join(f"\\Q{w}\\E" for w in words)
        between = rf"(?:^|{T.SPACE})(?:{any_word})(?:{T.SPACE}|\z)"
        return F.rlike(F.lower(clean), F.lit(between)).cast("int")
    return F.size(F.array_intersect(T.tokens(clean), F.array(*[F.lit(w) for w in words])))


def confidence(
    text: Column, lang: Column, words: Sequence[str] = fixed.COMMON_ENGLISH_WORDS
) -> Column:
    """How sure a detected language is; 0 for a blank text or an unknown language."""
    clean = T.strip(text)
    size = F.length(clean).cast("double")
    length_bonus = F.least(
        size / F.lit(float(fixed.LENGTH_DIVISOR)), F.lit(fixed.MAX_LENGTH_BONUS)
    )
    top = F.lit(fixed.MAX_PATTERN_BONUS)
    common = _common_words(clean, words)
    pattern_bonus = (
        F.when(lang.isin(fixed.CHINESE_LANGUAGES), F.least(T.char_share(clean), top))
        .when(lang == "en", F.least(common.cast("double") / F.lit(float(fixed.WORDS_DIVISOR)), top))
        .otherwise(F.lit(0.0))
    )
    score = F.least(F.lit(fixed.BASE_CONFIDENCE) + length_bonus + pattern_bonus, F.lit(1.0))
    known = (size > 0) & lang.isNotNull() & (lang != fixed.UNKNOWN_LANGUAGE)
    return F.when(known, score).otherwise(F.lit(0.0))


def confidences(text: Column) -> Column:
    """The confidence for every kind of language, to choose from once the language is known.

    Small, so that it can travel through a join in place of the text.
    """
    return F.struct(
        confidence(text, F.lit(fixed.CHINESE_LANGUAGES[0])).alias("chinese"),
        confidence(text, F.lit("en")).alias("english"),
        confidence(text, F.lit("other")).alias("other"),
    )


def chosen_confidence(all_: Column, lang: Column) -> Column:
    unknown = lang.isNull() | (lang == fixed.UNKNOWN_LANGUAGE)
    return (
        F.when(unknown, F.lit(0.0))
        .when(lang.isin(fixed.CHINESE_LANGUAGES), all_["chinese"])
        .when(lang == "en", all_["english"])
        .otherwise(all_["other"])
    )


def detected(text: Column, lang: Column) -> Column:
    """The language to go by: unknown for a blank text or one without a language."""
    return F.when(T.is_blank(text) | lang.isNull(), fixed.UNKNOWN_LANGUAGE).otherwise(lang)


def _by_language(lang: Column, part: int, default: Column, routes: Mapping[str, tuple]) -> Column:
    out = default
    for code, route in routes.items():
        out = F.when(lang == code, route[part]).otherwise(out)
    return out


def direction(
    df: DataFrame, lang: Column, routes: Mapping[str, tuple] = fixed.ROUTES
) -> DataFrame:
    """Add source_language, target_language and task_id.  Confidence plays no part in it."""
    unknown = T.fill("Unknown ({lang})", lang=lang)
    return df.withColumns(
        {
            "source_language": _by_language(lang, 0, unknown, routes),
            "target_language": _by_language(lang, 1, F.lit(fixed.DEFAULT_TARGET), routes),
            "task_id": _by_language(lang, 2, F.lit(fixed.DEFAULT_ROUTE_TASK), routes),
        }
    )


def script_language(text: Column, lang: Column, share: float = 0.1) -> Column:
    """Chinese when more than ``share`` of the characters are, whatever was detected."""
    return F.when(T.char_share(T.strip(text)) > share, "zh-cn").otherwise(lang)


def add_template(df: DataFrame, templates: DataFrame, task: str = "task_id") -> DataFrame:
    """Add the template of each row's task; null when the task has none."""
    table = templates.select(F.col("task_id").alias(task), "template")
    return lookup_join(df, table, [task])
