"""Stylometric features of a text as Columns over its word array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions import udf

CORE = ["ttr", "mattr", "stem_ttr", "herdan_c", "ttr_inflation", "bigram_diversity", "trigram_diversity", "avg_word_length", "avg_sentence_length", "sentence_length_sd", "punct_density", "fertility", "doc_len_words", "doc_len_chars"]
FULL = [*CORE, "latin_token_ratio"]
REDUCED = [f for f in FULL if f not in ("punct_density", "doc_len_words", "doc_len_chars", "latin_token_ratio")]


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def ttr(w: Column) -> Column:
    return share(F.size(F.array_distinct(w)), F.size(w))


def mattr(text: Column, window: int = 50) -> Column:
    """Mean type-token ratio of all windows; the plain ratio of shorter texts (an Arrow function, linear in the text)."""
    return udf.mattr_of(window)(text)


def fertility(text: Column, tokenizer_json: str) -> Column:
    """Subwords for each word, by a tokenizer of the tokenizers library; 0 for a text without words."""
    n = F.size(tx.words(F.coalesce(text, F.lit(""))))
    return F.when(n > 0, udf.subwords(tokenizer_json)(text) / n).otherwise(0.0)


def ngram_diversity(w: Column, n: int) -> Column:
    """Words hold no white space, so n-grams joined by a space stay distinct (and hash, as arrays don't)."""
    size = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.concat(*[p for k in range(n) for p in (F.lit(" "), F.get(w, i + k))][1:]))
    return F.when(size >= n, F.size(F.array_distinct(grams)) / (size - (n - 1))).otherwise(0.0)


def herdan_c(w: Column) -> Column:
    v, n = F.size(F.array_distinct(w)), F.size(w)
    return F.when((n > 1) & (v > 1), F.ln(v) / F.ln(n)).otherwise(0.0)


def avg_word_length(w: Column) -> Column:
    return F.when(F.size(w) > 0, mean(F.transform(w, lambda x: F.length(x).cast("double")))).otherwise(0.0)


def sentence_lengths(c: Column) -> Column:
    """Words of each plain sentence; of the whole text if it has none."""
    lengths = F.transform(tx.sentences(c), lambda s: F.size(tx.words(s)).cast("double"))
    return F.when(F.size(lengths) > 0, lengths).otherwise(F.array(F.size(tx.words(c)).cast("double")))


def sd(a: Column) -> Column:
    m = mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a) - m * m)


def feature_table(df: DataFrame, text: str = "text", keys: list[str] | None = None, suffixes: list[str] | None = None, fertility: Column | None = None) -> DataFrame:
    """Keys and all features. Words and sentence lengths are made once, below the features. Null text counts as empty.

    fertility: the column of that name, see fertility(); without a tokenizer it is 0.
    """
    keys = keys or [c for c in df.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    stems = tx.SINHALA_SUFFIXES if suffixes is None else suffixes
    rate = fertility if fertility is not None else F.lit(0.0)
    base = df.select(*keys, t.alias("_t"), mattr(t).alias("mattr"), rate.alias("fertility"))
    base = base.select("*", tx.words(F.col("_t")).alias("_w"), sentence_lengths(F.col("_t")).alias("_s"))
    base = base.select("*", F.array_distinct("_w").alias("_d"))
    base = base.select("*", F.size(F.array_distinct(F.transform("_d", lambda x: tx.stem(x, stems)))).alias("_st"), share(F.size("_d"), F.size("_w")).alias("ttr"))
    w, n = F.col("_w"), F.size("_w")
    m = mean(F.col("_s"))
    spread = tx.let(m, lambda mu: F.sqrt(mean(F.transform("_s", lambda x: (x - mu) * (x - mu)))))
    return base.select(
        *keys, "ttr", "mattr", share(F.col("_st"), n).alias("stem_ttr"), herdan_c(w).alias("herdan_c"), share(F.col("ttr"), F.col("mattr")).alias("ttr_inflation"),
        ngram_diversity(w, 2).alias("bigram_diversity"), ngram_diversity(w, 3).alias("trigram_diversity"), avg_word_length(w).alias("avg_word_length"), m.alias("avg_sentence_length"), spread.alias("sentence_length_sd"),
        (tx.punct_count(F.col("_t")) / F.greatest(n, F.lit(1))).alias("punct_density"), "fertility", n.alias("doc_len_words"), F.length("_t").alias("doc_len_chars"),
        share(F.size(F.filter(w, tx.is_latin)), n).alias("latin_token_ratio"),
    )
