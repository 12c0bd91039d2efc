"""Per-document text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import features as fx
from textloom.functions import text as tx
from textloom.plans.registry import SQL_DOCS, SQL_WORDS, dec, query, table

SUFFIXES = ["tion", "ción", "ment", "mente", "ing", "ung", "keit", "lich", "eau", "eux", "ed", "ly", "er", "en", "s"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "text", tx.words(F.col("text")).alias("w"))


@query(f"SELECT doc_id, len(w) AS n_words, len(text) AS n_code_points, CAST(coalesce(list_avg(list_transform(w, lambda x: len(x))), 0) AS DECIMAL(18,6)) AS avg_word_length FROM {SQL_DOCS}")
def doc_word_stats(spark, sf_dir):
    return worded(spark, sf_dir).select("doc_id", F.size("w").cast("long").alias("n_words"), F.length("text").cast("long").alias("n_code_points"), dec(fx.avg_word_length(F.col("w"))).alias("avg_word_length"))


@query(
    f"SELECT doc_id, CAST(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END AS DECIMAL(18,6)) AS ttr, "
    f"CAST(CASE WHEN len(w) > 1 AND len(list_distinct(w)) > 1 THEN ln(len(list_distinct(w))) / ln(len(w)) ELSE 0 END AS DECIMAL(18,6)) AS herdan_c FROM {SQL_DOCS}"
)
def doc_ttr_herdan(spark, sf_dir):
    w = F.col("w")
    return worded(spark, sf_dir).select("doc_id", dec(fx.ttr(w)).alias("ttr"), dec(fx.herdan_c(w)).alias("herdan_c"))


@query(
    f"WITH m AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS ttr, CASE WHEN len(w) > 50 THEN list_avg(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(w[i:i + 49])) / 50)) WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS mattr FROM {SQL_DOCS}) "
    "SELECT doc_id, CAST(mattr AS DECIMAL(18,5)) AS mattr, CAST(CASE WHEN mattr > 0 THEN ttr / mattr ELSE 0 END AS DECIMAL(18,5)) AS ttr_inflation FROM m"
)
def doc_mattr(spark, sf_dir):
    base = docs(spark, sf_dir).select("doc_id", fx.mattr(F.col("text")).alias("m"), fx.ttr(tx.words(F.col("text"))).alias("t"))
    return base.select("doc_id", dec("m", 5).alias("mattr"), dec(fx.share(F.col("t"), F.col("m")), 5).alias("ttr_inflation"))


def _ngram(n: int) -> str:
    joined = " || chr(1) || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return f"CAST(CASE WHEN len(w) >= {n} THEN len(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: {joined}))) / (len(w) - {n} + 1) ELSE 0 END AS DECIMAL(18,6))"


@query(f"SELECT doc_id, {_ngram(2)} AS bigram_diversity, {_ngram(3)} AS trigram_diversity FROM {SQL_DOCS}")
def doc_ngram_diversity(spark, sf_dir):
    w = F.col("w")
    return worded(spark, sf_dir).select("doc_id", dec(fx.ngram_diversity(w, 2)).alias("bigram_diversity"), dec(fx.ngram_diversity(w, 3)).alias("trigram_diversity"))


@query(
    r"""WITH s AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: len(regexp_split_to_array(x, '\s+'))) AS l FROM documents),
    t AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [n] END AS l FROM s)
    SELECT doc_id, CAST(list_avg(l) AS DECIMAL(18,5)) AS avg_sentence_length, CAST(list_stddev_pop(l) AS DECIMAL(18,5)) AS sentence_length_sd FROM t"""
)
def doc_sentence_stats(spark, sf_dir):
    base = docs(spark, sf_dir).select("doc_id", fx.sentence_lengths(F.col("text")).alias("s")).withColumn("m", fx.mean(F.col("s")))
    return base.select("doc_id", dec("m", 5).alias("avg_sentence_length"), dec(F.sqrt(fx.mean(F.transform("s", lambda x: (x - F.col("m")) * (x - F.col("m"))))), 5).alias("sentence_length_sd"))


@query(f"SELECT doc_id, CAST((len(text) - len(translate(text, '.,!?;:-_()[]{{}}\"''/\\|@#$%^&*+=<>~`', ''))) / greatest(1, len(w)) AS DECIMAL(18,6)) AS punct_density FROM {SQL_DOCS}")
def doc_punct_density(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", dec(tx.punct_density(F.col("text"))).alias("punct_density"))


@query("SELECT m AS mark, CAST(sum(len(text) - len(replace(text, m, ''))) AS BIGINT) AS n FROM documents, (SELECT unnest(string_split('.,!?;:-_()[]{}\"''/\\|@#$%^&*+=<>~`', '')) AS m) GROUP BY m")
def doc_punct_breakdown(spark, sf_dir):
    sums = docs(spark, sf_dir).agg(*[F.sum(tx.mark_count(F.col("text"), m)).alias(f"m{k}") for k, m in enumerate(tx.MARKS)])
    pairs = F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"m{k}").cast("long").alias("n")) for k, m in enumerate(tx.MARKS)])
    return sums.select(F.explode(pairs).alias("x")).select("x.mark", "x.n")


_STEM = "CASE " + " ".join(f"WHEN ends_with(x, '{s}') AND len(x) >= {len(s) + 2} THEN left(x, len(x) - {len(s)})" for s in sorted(SUFFIXES, key=len, reverse=True)) + " ELSE x END"


@query(f"SELECT doc_id, CAST(CASE WHEN len(w) > 0 THEN len(list_distinct(list_transform(w, lambda x: {_STEM}))) / len(w) ELSE 0 END AS DECIMAL(18,6)) AS stem_ttr FROM {SQL_DOCS}")
def doc_stem_ttr(spark, sf_dir):
    stems = worded(spark, sf_dir).select("doc_id", F.transform("w", lambda x: tx.stem(x, SUFFIXES)).alias("s"))
    return stems.select("doc_id", dec(fx.ttr(F.col("s"))).alias("stem_ttr"))


@query(f"SELECT doc_id, CAST(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) AS BIGINT) AS latin_tokens, CAST(CASE WHEN len(text) > 0 THEN len(regexp_replace(text, '[^A-Za-z]', '', 'g')) / len(text) ELSE 0 END AS DECIMAL(18,6)) AS latin_ratio FROM {SQL_DOCS}")
def doc_latin_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.latin_count(F.col("text")).cast("long").alias("latin_tokens"), dec(tx.latin_char_ratio(F.col("text"))).alias("latin_ratio"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\s]*[A-Za-z][^\s]*', '<LAT>', 'g') AS text FROM documents")
def latin_placeholder(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.latin_to_placeholder(F.col("text")).alias("text"))


@query("SELECT doc_id, translate(text, '“”„‟‘’‚‛«»‹›`‐‑‒–—―−', '\"\"\"\"''''''''\"\"''''''-------') AS text FROM documents")
def normalize_quotes_dashes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.straighten(F.col("text")).alias("text"))


def _collapsed(c: str) -> str:
    for m in "!?.,;:-_*#~":
        c = f"regexp_replace({c}, '[{m}]{{2,}}', '{m}', 'g')"
    return c


@query(f"SELECT doc_id, {_collapsed('text')} AS text FROM documents")
def collapse_repeats(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.collapse_repeats(F.col("text")).alias("text"))


def _tidied(c: str) -> str:
    c = _collapsed(f"translate(nfc_normalize({c}), '“”„‟‘’‚‛«»‹›`‐‑‒–—―−', '\"\"\"\"''''''''\"\"''''''-------')")
    c = rf"regexp_replace(regexp_replace({c}, '[ \t\x{{A0}}\x{{200B}}-\x{{200D}}]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(array_to_string(list_transform(string_split({c}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_tidied('text')} AS text FROM documents")
def normalize_punct(spark, sf_dir):
    from textloom.functions.udf import composed

    return docs(spark, sf_dir).select("doc_id", tx.tidy(composed(F.col("text"))).alias("text"))


_LATIN = r"regexp_replace(m, '[^\s]*[A-Za-z][^\s]*', '<LAT>', 'g')"


@query(rf"""SELECT doc_id, {_tidied(_LATIN)} AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\[\[[^\]]*\]\]', ' ', 'g'), '\{{\{{[^}}]*\}}\}}', ' ', 'g'), '(?i)[^\s]+\.(?:jpg|jpeg|png|gif|svg|ogg|webp)\b', ' ', 'g') AS m FROM documents)""")
def normalize_full(spark, sf_dir):
    from textloom.functions.udf import composed

    # two projections, so that only texts that NFC may change go to Python
    stripped = docs(spark, sf_dir).select("doc_id", tx.normalise(F.col("text"), punctuation=False).alias("text"))
    return stripped.select("doc_id", tx.tidy(composed(F.col("text"))).alias("text"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '\[\[[^\]]*\]\]')) + len(regexp_extract_all(html, '\{\{[^}]*\}\}')) > 0 AS has_links,
    CAST(len(regexp_extract_all(html, '(?i)[^\s]+\.(?:jpg|jpeg|png|gif|svg|ogg|webp)\b')) AS BIGINT) AS images, CAST(len(regexp_extract_all(html, '(?i)\blink\s*=\s*[^\s]*')) AS BIGINT) AS links FROM pages"""
)
def has_markup_counts(spark, sf_dir):
    h = F.col("html")
    count = lambda k: F.regexp_count(h, F.lit(tx.MARKUP[k])).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", (h.rlike(tx.MARKUP[0]) | h.rlike(tx.MARKUP[1])).alias("has_links"), count(3).alias("images"), count(4).alias("links"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '\[\[[^\]]*\]\]', ' ', 'g'), '\{\{[^}]*\}\}', ' ', 'g') AS html FROM pages")
def strip_wiki_links(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(h, tx.MARKUP[0], " "), tx.MARKUP[1], " ").alias("html"))


@query(f"SELECT doc_id, array_to_string(w[1:50], ' ') AS text FROM {SQL_DOCS}")
def truncate_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.first_words(F.col("text"), 50).alias("text"))


@query(f"SELECT doc_id, translate(left(text, 60), chr(10), ' ') AS preview, regexp_matches(replace(text, '<LAT>', ''), '[\\p{{P}}\\p{{S}}]') AS has_punctuation FROM documents")
def doc_preview(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.preview(F.col("text")).alias("preview"), tx.has_punctuation(F.col("text")).alias("has_punctuation"))


@query(
    f"SELECT doc_id, 'Write ' || CAST(greatest(20, CAST(round_even(0.8::DOUBLE * n, 0) AS BIGINT)) AS VARCHAR) || '-' || CAST(CAST(round_even(1.2::DOUBLE * n, 0) AS BIGINT) AS VARCHAR) || ' words like {{title}}: ' || left(text, 40) AS prompt "
    f"FROM (SELECT doc_id, text, CASE WHEN len(w) = 0 THEN 200 ELSE len(w) END AS n FROM {SQL_DOCS})"
)
def prompt_fill(spark, sf_dir):
    low, high = tx.target_band(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", tx.fill("Write {low}-{high} words like {title}: {head}", {"low": low, "high": high, "title": F.lit("{title}"), "head": F.substring("text", 1, 40)}).alias("prompt"))


_FEATURES = ["ttr", "stem_ttr", "bigram_diversity", "trigram_diversity", "avg_word_length", "punct_density", "latin_token_ratio"]


@query(
    f"SELECT doc_id, lang, CAST(CASE WHEN n > 0 THEN len(list_distinct(w)) / n ELSE 0 END AS DECIMAL(18,6)) AS ttr, CAST(CASE WHEN n > 0 THEN len(list_distinct(list_transform(w, lambda x: {_STEM}))) / n ELSE 0 END AS DECIMAL(18,6)) AS stem_ttr, "
    f"{_ngram(2)} AS bigram_diversity, {_ngram(3)} AS trigram_diversity, CAST(coalesce(list_avg(list_transform(w, lambda x: len(x))), 0) AS DECIMAL(18,6)) AS avg_word_length, "
    "CAST((len(text) - len(translate(text, '.,!?;:-_()[]{}\"''/\\|@#$%^&*+=<>~`', ''))) / greatest(1, n) AS DECIMAL(18,6)) AS punct_density, "
    f"CAST(CASE WHEN n > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]'))) / n ELSE 0 END AS DECIMAL(18,6)) AS latin_token_ratio, CAST(n AS BIGINT) AS doc_len_words, CAST(len(text) AS BIGINT) AS doc_len_chars FROM (SELECT *, len(w) AS n FROM {SQL_DOCS})"
)
def feature_table(spark, sf_dir):
    out = fx.feature_table(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), suffixes=SUFFIXES)
    return out.select("doc_id", "lang", *[dec(f).alias(f) for f in _FEATURES], F.col("doc_len_words").cast("long"), F.col("doc_len_chars").cast("long"))


@query()
def doc_fertility(spark, sf_dir):
    """Subwords a word by a public tokenizer (no SQL: the tokenizers library; tested against it)."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return docs(spark, sf_dir).select("doc_id", fx.fertility(F.col("text"), tokenizer).alias("fertility"))


@query()
def segmented_sentences(spark, sf_dir):
    """Rule-based sentences, one row each (no SQL: a stateful scan; tested against its rules)."""
    from textloom.functions.udf import segmented

    return segmented(docs(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, CAST(i // 32 AS INTEGER) AS win, i AS start, array_to_string(w[i + 1:i + 64], ' ') AS tokens FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 32)) AS i FROM {SQL_DOCS}) WHERE i = 0 OR i < len(w) - 32")
def token_windows(spark, sf_dir):
    n = F.size("w")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(32)), lambda i: (i == 0) | (i < n - 32))
    return worded(spark, sf_dir).select("doc_id", "w", F.explode(starts).alias("i")).select("doc_id", F.expr("cast(i div 32 as int)").alias("win"), F.col("i").cast("long").alias("start"), F.array_join(F.slice("w", F.col("i") + 1, 64), " ").alias("tokens"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest({SQL_WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM documents),
    x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n), l AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM x GROUP BY doc_id)
    SELECT doc_id, count(*) AS terms, CAST(max(v / l) AS DECIMAL(18,6)) AS top_weight, CAST(sum(v / l) AS DECIMAL(18,5)) AS total_weight FROM x JOIN l USING (doc_id) GROUP BY doc_id"""
)
def tfidf_weights(spark, sf_dir):
    from textloom.operators.ml import tfidf

    v = tfidf(docs(spark, sf_dir), "doc_id", "text", ngrams=(1,), min_df=2)
    return v.groupBy("doc_id").agg(F.count("*").alias("terms"), dec(F.max("weight")).alias("top_weight"), dec(F.sum("weight"), 5).alias("total_weight"))


@query(f"SELECT doc_id, len({SQL_WORDS}) = len(list_filter(regexp_split_to_array(regexp_replace(text, '\\d+', '', 'g'), '\\s+'), lambda x: x <> '')) AS same FROM documents")
def word_count_preserved(spark, sf_dir):
    """Whether a text without its digits has as many words."""
    return docs(spark, sf_dir).select("doc_id", tx.same_word_count(F.col("text"), F.regexp_replace("text", r"\d+", "")).alias("same"))
