"""Arrow functions for what Spark has no built-in: NFC, rule-based sentences, exact binomial tails."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values.
ENDS = ".?!෴…"
CLOSERS = "\"'’”)]}»"
ABBREVIATIONS = frozenset(
    ["ආචාර්ය", "මහාචාර්ය", "පූජ්‍ය", "ශ්‍රී", "මයා", "මිය", "අංක", "ක්‍රි.ව", "ක්‍රි.පූ", "ඉ.පෙ", "පි.ව", "Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Jr", "Sr", "vs", "etc", "No", "Fig", "Vol", "pp", "ed", "eds", "cf", "al"]
)
LEAST = 15
LETTER = re.compile(r"[^\W\d_]")
_END, _RUN = re.escape(ENDS), f"[{re.escape(ENDS + CLOSERS)}]*"
#: Each terminator that only terminators and closers part from white space or the end (of dots in a row the last), and each line's end.
EVENT = re.compile(rf"(?:\.(?!\.)|[{_END.replace(re.escape('.'), '', 1)}])(?={_RUN}(?:\s|\Z))|\n")
TAIL = re.compile(_RUN)
BREAK = re.compile(r"[\r\n]*")
ENDED = re.compile(rf"[{_END}][{re.escape(CLOSERS)}]*\Z")
#: Quotation marks as (opening, closing); equal ones take turns.
QUOTES = (('"', '"'), ("“", "”"), ("‘", "’"))


#: Characters that NFC may change or join with others; a text without one is in NFC (tested on all code points).
UNSTABLE = r"[\x{300}-\x{10FFFF}&&[^\x{400}-\x{482}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]]"
#: Characters that a tokenizer gets at once: its results take many times a text's room.
ENCODE_CHARS = 250_000
#: Characters of sentences that leave a task at once.
SEGMENT_CHARS = 500_000


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """NFC of a column; only texts that may change go to Python. The column is read thrice, so it should be a plain one."""
    unstable = c.rlike(UNSTABLE)
    return F.when(unstable, nfc(F.when(unstable, c))).otherwise(c)


def quotations(text: str) -> list[tuple[list[int], list[int]]]:
    """Places of the opening and the closing marks, for each kind whose marks are balanced."""
    found = []
    for left, right in QUOTES:
        marks = {q: [m.start() for m in re.finditer(q, text)] for q in (left, right)}
        opens, closes = (marks[left][::2], marks[left][1::2]) if left == right else (marks[left], marks[right])
        if opens and len(opens) == len(closes):
            found.append((opens, closes))
    return found


def no_end(text: str, at: int, marks: list[tuple[list[int], list[int]]]) -> bool:
    """Whether the terminator at this place ends no sentence: more quotations are open than closed there, or it belongs to an abbreviation or initial."""
    if any(bisect_left(opens, at) > bisect_left(closes, at) for opens, closes in marks):
        return True
    if text[at] != ".":
        return False
    word = re.search(r"\S*\Z", text[max(0, at - 64) : at])[0]
    if len(word) == 1:
        return word.isascii() and word.isalpha()
    return any(word in (a, a.replace(".", "")) or word.endswith(f".{a}") for a in ABBREVIATIONS)


def split_sentences(text: str | None) -> list[str]:
    """Sentences by rule. Quotations, abbreviations and inner dots don't end one; a line's end always does.

    Every piece gets the number of its sentence: one without a letter, or a short
    one without a terminator, the number of the piece before. What is then the
    first sentence, if it is such itself, goes with the second.
    """
    text = text or ""
    marks, pieces, start = quotations(text), [], 0
    for event in EVENT.finditer(text):
        at = event.start()
        if at < start or text[at] != "\n" and no_end(text, at, marks):
            continue
        end = at if text[at] == "\n" else TAIL.match(text, at).end()
        pieces.append(text[start:end].strip())
        start = BREAK.match(text, at).end() if text[at] == "\n" else end
    pieces = [p for p in (*pieces, text[start:].strip()) if p]

    def whole(piece: str) -> bool:
        return bool(LETTER.search(piece)) and (len(piece) >= LEAST or bool(ENDED.search(piece)))

    number = accumulate(map(whole, pieces[1:]), initial=0)
    found = [" ".join(p for _, p in group) for _, group in groupby(zip(number, pieces, strict=True) if pieces else (), key=lambda x: x[0])]
    if len(found) > 1 and not whole(found[0]):
        found = [f"{found[0]} {found[1]}", *found[2:]]
    return [" ".join(s.split()) for s in found]


def segmented(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, sentence): the rule-based sentences of each row, one row each. A task holds the sentences of about SEGMENT_CHARS characters at once."""
    keyed = df.select(F.col(key).alias(key), F.col(text).alias("text"))
    out = T.StructType([keyed.schema[key], T.StructField("pos", T.IntegerType()), T.StructField("sentence", T.StringType())])

    def split(batches):
        schema, rows, size = to_arrow_schema(out), ([], [], []), 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                found = split_sentences(t.as_py())
                rows[0].extend([k.as_py()] * len(found))
                rows[1].extend(range(len(found)))
                rows[2].extend(found)
                size += sum(map(len, found))
                if size >= SEGMENT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, size = ([], [], []), 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return keyed.mapInArrow(split, out)


@F.pandas_udf(T.IntegerType())
def sentence_count(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(split_sentences(t)))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of k of n at one half; 1 for n = 0."""
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * tail)


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(min(x, y), x + y) if x + y else 1.0 for x, y in zip(b, c, strict=True)], dtype="float64")


def subwords(tokenizer_json: str):
    """Number of a text's tokens by a tokenizer of the tokenizers library (its file's text), without special tokens; null as empty."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        tokenizer, found = loaded(tokenizer_json), []
        for some in slices(texts):
            found += [len(e) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return pd.Series(found, dtype="int64")

    return count


def slices(texts: pd.Series, most: int = ENCODE_CHARS) -> Iterator[list[str]]:
    """The texts, null as empty, in lists of at most `most` characters; a longer text is one of its own."""
    some, size = [], 0
    for t in texts:
        t = t or ""
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


_tokenizers: dict[int, object] = {}


def loaded(tokenizer_json: str):
    """One tokenizer for each worker, kept for later batches."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(tokenizer_json)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer.from_str(tokenizer_json)
    return _tokenizers[key]


def rolling_ttr(words: list[str], window: int) -> float:
    """Mean type-token ratio of all windows, in linear time: each word is the first of its kind in one run of windows."""
    n = len(words)
    if n <= window:
        return len(set(words)) / n if n else 0.0
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    order = np.argsort(codes, kind="stable")
    before = np.full(n, -1)
    again = codes[order[1:]] == codes[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    first = np.maximum(np.maximum(before + 1, np.arange(n) - window + 1), 0)
    last = np.minimum(np.arange(n), n - window)
    counted = first <= last
    return float((last - first + 1)[counted].sum()) / (n - window + 1) / window


def mattr_of(window: int = 50):
    """Moving-average type-token ratio of a text; null as empty. str.split() takes for white space what functions/text.py does."""

    @F.pandas_udf(T.DoubleType())
    def ratio(texts: pd.Series) -> pd.Series:
        return pd.Series([rolling_ttr((t or "").split(), window) for t in texts], dtype="float64")

    return ratio
