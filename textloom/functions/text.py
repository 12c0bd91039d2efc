"""Column builders for text: words, script tests, clean-up, punctuation, sentences, stems.

White space means every code point for which a text is white space in Unicode,
and U+001C to U+001F; Spark's own `trim` and `\\s` know fewer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (patterns, tables, lists) that results depend on.
WS = r"\s\x1c-\x1f"
WS_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPLIT = rf"(?U)[{WS}]+"
SINHALA = r"\x{0D80}-\x{0DFF}"
PLACEHOLDER = "<LAT>"
#: First the range that holds all of them, so that other characters are passed over at one look.
EMOJI = r"[\x{2190}-\x{1FAFF}&&[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}]]+"
#: Word edges as letters, digits and underscore make them; vowel signs are no word characters.
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
FILE_END = r"(?iU:\.(?:jpg|jpeg|png|gif|svg|ogg|webp))"
MARKUP = [
    r"\[\[[^\]]*\]\]",
    r"\{\{[^}]*\}\}",
    rf"(?iU){EDGE_L}(?:File|Image)[{WS}]*:[{WS}]*[^{WS}]+",
    rf"(?iU)(?<![^{WS}])[^{WS}]+{FILE_END}{EDGE_R}",
    rf"(?iU)(?=l){EDGE_L}link[{WS}]*=[{WS}]*[^{WS}]*",
    rf"(?iU)(?=[trlfu]){EDGE_L}(?:thumb|thumbnail|right|left|frameless|frame|upright){EDGE_R}",
]
QUOTES_FROM, QUOTES_TO = "“”„‟‘’‚‛«»‹›`", "\"\"\"\"''''\"\"'''"
DASHES_FROM, DASHES_TO = "‐‑‒–—―−", "-------"
REPEATED = r"([!?.,;:\-_*#~])\1+"
SPACE_RUN = "[[^!-~]&&[ \t ​‌‍]]{2,}"
MARKS = ".,!?;:-_()[]{}\"'/\\|@#$%^&*+=<>~`"
SENTENCE_END = r"[.!?\n]+"
SINHALA_SUFFIXES = ["වලින්", "වලට", "වලදී", "වෙන්", "ගෙන්", "ලාගේ", "න්ගේ", "යින්", "ට්ම", "ෙන්", "ෙහි", "ගේ", "ට", "ෙක්", "යි", "ෙකි", "වේ", "යට", "ක්", "ම", "ය", "න්", "ව", "ි"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utrim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    """Runs of other than white space; an empty array for empty text."""
    return F.array_remove(F.split(c, SPLIT), "")


def is_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & ~c.rlike(f"[{SINHALA}]")


def latin_to_placeholder(c: Column) -> Column:
    """Each Latin word becomes the placeholder; white space stays as it is."""
    return F.regexp_replace(c, rf"(?U)(?<![^{WS}])(?=[^{WS}]*[A-Za-z])(?![^{WS}]*[{SINHALA}])[^{WS}]+", PLACEHOLDER)


def latin_count(c: Column) -> Column:
    return F.size(F.filter(words(c), is_latin))


def latin_char_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit("[A-Za-z]")) / F.length(c)).otherwise(0.0)


def same_word_count(before: Column, after: Column) -> Column:
    """Whether a rewrite has kept the number of words."""
    return F.size(words(before)) == F.size(words(after))


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def count_emoji(c: Column) -> Column:
    return F.regexp_count(c, F.lit(EMOJI))


def strip_markup(c: Column) -> Column:
    for k, pattern in enumerate(MARKUP):
        # files' names are sought from every word's start, so first whether there is an ending at all
        c = let(c, lambda t: F.when(t.rlike(FILE_END), F.regexp_replace(t, MARKUP[3], " ")).otherwise(t)) if k == 3 else F.regexp_replace(c, pattern, " ")
    return c


def markup_count(c: Column) -> Column:
    return sum((F.regexp_count(c, F.lit(p)) for p in MARKUP), F.lit(0))


def has_markup(c: Column) -> Column:
    out = F.lit(False)
    for p in MARKUP:
        out = out | c.rlike(p)
    return out


def straighten(c: Column) -> Column:
    """Typographic quotes and dashes to ASCII."""
    return F.translate(c, QUOTES_FROM + DASHES_FROM, QUOTES_TO + DASHES_TO)


def collapse_repeats(c: Column) -> Column:
    return F.regexp_replace(c, REPEATED, "$1")


def tidy(c: Column) -> Column:
    """Quotes, dashes, repeated marks, runs of spaces and newlines, ends of lines. NFC comes before (udf.nfc)."""
    c = F.regexp_replace(F.regexp_replace(collapse_repeats(straighten(c)), SPACE_RUN, " "), "\n{3,}", "\n\n")
    return utrim(F.array_join(F.transform(F.split(c, "\n"), utrim), "\n"))


def normalise(c: Column, latin: bool = True, emoji: bool = True, markup: bool = True, punctuation: bool = True, nfc: bool = True) -> Column:
    """The whole normaliser: markup, emoji, Latin words, punctuation, in this order."""
    from textloom.functions.udf import nfc as compose

    c = strip_markup(c) if markup else c
    c = strip_emoji(c) if emoji else c
    c = latin_to_placeholder(c) if latin else c
    if punctuation:
        c = tidy(compose(c) if nfc else c)
    return c


def first_words(c: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words(c), F.lit(1), n if isinstance(n, Column) else F.lit(n)), " ")


def mark_count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def punct_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, MARKS, ""))


def punct_density(c: Column) -> Column:
    return punct_count(c) / F.greatest(F.size(words(c)), F.lit(1))


def has_punctuation(c: Column) -> Column:
    """Any punctuation or symbol, the placeholder aside."""
    return F.replace(c, F.lit(PLACEHOLDER), F.lit("")).rlike(r"[\p{P}\p{S}]")


def sentences(c: Column) -> Column:
    """The plain split on . ! ? and newline."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), utrim), lambda s: s != "")


def stem(word: Column, suffixes: list[str], least: int = 2) -> Column:
    """Without its longest listed suffix, if `least` characters remain."""
    out = F.when(F.lit(False), word)
    for s in sorted(suffixes, key=len, reverse=True):
        out = out.when(F.endswith(word, F.lit(s)) & (F.length(word) >= len(s) + least), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)


def preview(c: Column, n: int = 60) -> Column:
    return F.translate(F.substring(c, 1, n), "\n", " ")


def fill(template: str, values: dict[str, Column]) -> Column:
    """Fills {name} slots in one pass: what is filled in is never expanded again; null fills nothing."""
    import re

    parts = re.split(r"(\{\w+\})", template)
    return F.concat(*[F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p[1:-1] in values and p.startswith("{") else F.lit(p) for p in parts if p])


def target_band(text: Column, caption: Column | None = None) -> tuple[Column, Column]:
    """Words wanted of a generated text: 0.8 to 1.2 times the source's (200 if it has none), 20 at least."""
    n = F.size(words(F.coalesce(text, caption if caption is not None else F.lit(""), F.lit(""))))
    n = F.when(n == 0, 200).otherwise(n)
    return F.greatest(F.lit(20), F.bround(n * F.lit(0.8), 0).cast("int")), F.bround(n * F.lit(1.2), 0).cast("int")
