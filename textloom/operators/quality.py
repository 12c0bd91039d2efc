"""Content-quality checks as boolean columns, and clean/rejected partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx

#: Fixed values.
CATEGORY_PREFIX = "ප්‍රවර්ගය:"
CATEGORY_WORD = r"(?:\x{0DB4}\x{0DCA}\x{200D}?\x{0DBB}\x{0DC0}\x{0DBB}\x{0DCA}\x{0D9C}\x{0DBA}|Category)"
CATEGORY_LINE = rf"(?md)^[ \t]*(?:\[\[)?[ \t]*{CATEGORY_WORD}[ \t]*:.*$"
CATEGORY_GLUED = rf"(?md)(?<=[.!?\x{{0964}}])[ \t]*(?:\[\[)?[ \t]*{CATEGORY_WORD}[ \t]*:[^\n]*$"
DISAMBIGUATION = ("යොමු විය හැක්කේ", "වෙත යොමු කරයි")
RESIDUAL = ("thumb|", "right|", "left|", "link=", "px|", "[[File:", "[[Image:")
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FOREIGN = r"[[^\x{00}-\x{7F}\x{0D80}-\x{0DFF}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{20D0}-\x{20FF}]&&[\p{L}\p{M}\p{Cn}\p{Co}\p{Cs}\p{Cc}\x{FFFD}]]"
#: What every category word begins with.
CATEGORY_STARTS = ("Category", "\u0DB4\u0DCA")


def strip_categories(c: Column) -> Column:
    """Removes category tags on lines of their own or glued to a sentence; other text stays byte for byte."""
    cut = F.regexp_replace(F.regexp_replace(c, CATEGORY_GLUED, ""), CATEGORY_LINE, "")
    return F.when(contains_any(c, CATEGORY_STARTS) & (c.rlike(CATEGORY_LINE) | c.rlike(CATEGORY_GLUED)), tx.utrim(F.regexp_replace(cut, "\n{3,}", "\n\n"))).otherwise(c)


def category_only(c: Column, prefix: str = CATEGORY_PREFIX) -> Column:
    lines = F.filter(F.transform(F.split(c, LINE_ENDS), tx.utrim), lambda x: x != "")
    return F.startswith(F.ltrim(c, F.lit(tx.WS_CHARS)), F.lit(prefix)) & (F.size(lines) > 0) & F.forall(lines, lambda x: F.startswith(x, F.lit(prefix)))


def contains_any(c: Column, parts: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def disambiguation(c: Column, markers: tuple[str, ...] | list[str] = DISAMBIGUATION, max_words: int = 100, n_words: Column | None = None) -> Column:
    return contains_any(c, markers) & ((F.size(tx.words(c)) if n_words is None else n_words) < max_words)


def foreign_share(c: Column) -> Column:
    """Letters, marks and junk outside ASCII and Sinhala, of all but format characters."""
    visible = F.length(c) - F.regexp_count(c, F.lit(r"\p{Cf}"))
    return F.when(visible > 0, F.regexp_count(c, F.lit(FOREIGN)) / visible).otherwise(0.0)


def corrupted(c: Column, threshold: float = 0.15) -> Column:
    return foreign_share(c) > threshold


def script_share(c: Column, script: str = tx.SINHALA) -> Column:
    """Share of letters that are in a script's block; null without letters."""
    return F.regexp_count(c, F.lit(rf"[[{script}]&&\p{{L}}]")) / F.nullif(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(0))


def insufficient_script(c: Column, least: float = 0.5, script: str = tx.SINHALA) -> Column:
    return F.coalesce(script_share(c, script) < least, F.lit(False))


CHECKS = ["not_category_only", "not_disambiguation", "sufficient_length", "no_residual_markup", "no_encoding_corruption", "sufficient_script"]


def quality_flags(df: DataFrame, text: str = "text", title: str | None = None, min_words: int = 100, script: str = tx.SINHALA, prefix: str = CATEGORY_PREFIX, markers: tuple[str, ...] | list[str] = DISAMBIGUATION, threshold: float = 0.15, least: float = 0.5) -> DataFrame:
    """df with the six checks and `passed`. Category pages are judged by the raw text, all else without tags. Null is empty.

    The text without tags and its number of words stand beside them, as `_body` and
    `_n_words`. The checks come out of a generator, so that a filter on them is not
    moved below it, where each would be computed again for every use.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn("_body", strip_categories(raw))
    base = base.withColumn("_n_words", F.size(tx.words(F.col("_body"))))
    body, n = F.col("_body"), F.col("_n_words")
    bad_title = corrupted(F.coalesce(F.col(title), F.lit("")), threshold) if title else F.lit(False)
    flags = [~category_only(raw, prefix), ~disambiguation(body, markers, n_words=n), n >= min_words, ~contains_any(body, RESIDUAL), ~(corrupted(body, threshold) | bad_title), ~insufficient_script(body, least, script)]
    out = base.select(*df.columns, "_body", "_n_words", F.explode(F.array(F.struct(*[f.alias(c) for f, c in zip(flags, CHECKS, strict=True)]))).alias("_f")).select(*df.columns, "_body", "_n_words", "_f.*")
    return out.withColumn("passed", F.forall(F.array(*CHECKS), lambda x: x))


def clean_and_rejected(df: DataFrame, text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, with tags stripped and without the checks; rows that don't, with all checks)."""
    flagged = quality_flags(df, text, **options)
    clean = flagged.filter("passed").withColumn(text, F.col("_body")).select(*df.columns)
    return clean, flagged.filter("NOT passed").drop("_body", "_n_words")


def date_partition(df: DataFrame, columns: list[str], cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(all dates known and before the cutoff, the rest)."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c) < F.lit(cutoff).cast("timestamp"), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def source_items(df: DataFrame, text: str, min_words: int = 0, script: str = tx.SINHALA) -> DataFrame:
    """Usable source rows: text present, long enough (cheapest test first), not corrupted, in the script."""
    kept = df.filter(F.col(text).isNotNull()).filter(F.size(tx.words(F.col(text))) >= min_words)
    return kept.filter(~corrupted(F.col(text)) & ~insufficient_script(F.col(text), script=script))
