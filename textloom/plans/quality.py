"""Quality flags, partitions, dates and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import allocation, quality
from textloom.plans.registry import SQL_DOCS, dec, query, table

MARKERS = ["the", "von"]
_FLAGS = (
    r"SELECT doc_id, n_words >= 100 AS sufficient_length, NOT has_markup AS no_residual_markup, foreign_share <= 0.05 AS no_encoding_corruption, NOT ((contains(text, 'the') OR contains(text, 'von')) AND n_words < 30) AS not_disambiguation, "
    r"NOT (letters > 0 AND accented / greatest(letters, 1) < 0.02) AS sufficient_script FROM (SELECT doc_id, text, len(w) AS n_words, contains(text, 'link=') OR contains(text, 'px|') OR contains(text, 'thumb|') OR contains(text, '[[File:') AS has_markup, "
    r"CASE WHEN len(text) > 0 THEN len(regexp_replace(text, '[^\x{80}-\x{10FFFF}]', '', 'g')) / len(text) ELSE 0 END AS foreign_share, len(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, len(regexp_replace(text, '[^\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', '', 'g')) AS accented FROM " + SQL_DOCS + ")"
)


def flagged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_flags(docs, min_words=100, script=r"\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}", markers=MARKERS, threshold=0.05, least=0.02).withColumn("not_disambiguation", ~quality.disambiguation(F.col("_body"), MARKERS, 30, F.col("_n_words")))


@query(_FLAGS)
def quality_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", "sufficient_length", "no_residual_markup", "no_encoding_corruption", "not_disambiguation", "sufficient_script")


@query(f"SELECT doc_id FROM ({_FLAGS}) WHERE sufficient_length AND no_residual_markup AND no_encoding_corruption AND not_disambiguation AND sufficient_script")
def quality_clean(spark, sf_dir):
    keep = F.forall(F.array("sufficient_length", "no_residual_markup", "no_encoding_corruption", "not_disambiguation", "sufficient_script"), lambda x: x)
    return flagged(spark, sf_dir).filter(keep).select("doc_id")


@query(f"SELECT doc_id, sufficient_length, no_encoding_corruption FROM ({_FLAGS}) WHERE NOT (sufficient_length AND no_residual_markup AND no_encoding_corruption AND not_disambiguation AND sufficient_script)")
def quality_rejected(spark, sf_dir):
    keep = F.forall(F.array("sufficient_length", "no_residual_markup", "no_encoding_corruption", "not_disambiguation", "sufficient_script"), lambda x: x)
    return flagged(spark, sf_dir).filter(~keep).select("doc_id", "sufficient_length", "no_encoding_corruption")


@query(r"SELECT doc_id, CAST(len(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(len(regexp_replace(text, '[^\p{L}]', '', 'g')), 0) AS DECIMAL(18,6)) AS script_ratio FROM documents")
def script_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", dec(quality.script_share(F.col("text"), "A-Za-z")).alias("script_ratio"))


@query(r"SELECT doc_id, CAST(CASE WHEN len(text) > 0 THEN len(regexp_replace(text, '[^\p{L}\p{M}]|[A-Za-z]', '', 'g')) / len(text) ELSE 0 END AS DECIMAL(18,6)) AS foreign_share FROM documents")
def encoding_corruption(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", dec(quality.foreign_share(F.col("text"))).alias("foreign_share"))


@query("SELECT doc_id, len(lines) > 0 AND len(list_filter(lines, lambda x: NOT starts_with(x, 'The'))) = 0 AS prefix_only FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)")
def category_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.category_only(F.col("text"), "The").alias("prefix_only"))


_TAG = r"[ \t]*(?:\[\[)?[ \t]*(?:\x{0DB4}\x{0DCA}\x{200D}?\x{0DBB}\x{0DC0}\x{0DBB}\x{0DCA}\x{0D9C}\x{0DBA}|Category)[ \t]*:"
_LINE, _GLUED = rf"(?m)^{_TAG}.*$", rf"(?m)([.!?\x{{0964}}]){_TAG}[^\n]*$"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    rf"SELECT page_id, regexp_matches(html, 'Category[ \t]*:') AS tagged, CASE WHEN regexp_matches(html, '{_LINE}') OR regexp_matches(html, '{_GLUED}') THEN "
    rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{_GLUED}', '\1', 'g'), '{_LINE}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') ELSE html END AS text FROM pages"
)
def strip_categories(spark, sf_dir):
    """All pages, their category tags taken out."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.col("html").rlike(r"Category[ \t]*:").alias("tagged"), quality.strip_categories(F.col("html")).alias("text"))


@query("SELECT page_id, html AS text FROM pages")
def strip_inserted_categories(spark, sf_dir):
    """Tags put behind every page go again, and nothing else does."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", quality.strip_categories(F.concat("html", F.lit("\n\nCategory:Rivers\nCategory : Lakes"))).alias("text"))


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority IS NOT NULL AS passed FROM orders")
def date_cutoff_partition(spark, sf_dir):
    old, new = quality.date_partition(table(spark, sf_dir, "orders"), ["o_orderdate"], "1996-01-01")
    return old.select("o_orderkey", F.lit(True).alias("passed")).unionByName(new.select("o_orderkey", F.lit(False).alias("passed")))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1")
def counts_by_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query(
    "SELECT c AS cutoff, count(*) FILTER (WHERE o_orderdate < CAST(c AS TIMESTAMP)) AS before, count(*) FILTER (WHERE o_orderdate < CAST(c AS TIMESTAMP) AND l_shipdate < CAST(c AS TIMESTAMP)) AS both_before "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey, (VALUES ('1994-01-01'), ('1997-01-01')) t(c) GROUP BY c"
)
def counts_under_cutoffs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    at = lambda c: F.lit(c).cast("timestamp")
    cutoffs = ["1994-01-01", "1997-01-01"]
    wide = rows.agg(*[F.count_if(F.col("o_orderdate") < at(c)).alias(f"b{k}") for k, c in enumerate(cutoffs)], *[F.count_if((F.col("o_orderdate") < at(c)) & (F.col("l_shipdate") < at(c))).alias(f"d{k}") for k, c in enumerate(cutoffs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"b{k}").alias("before"), F.col(f"d{k}").alias("both_before")) for k, c in enumerate(cutoffs)])).alias("x")).select("x.*")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), 'blog.*/en') OR regexp_matches(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'blog.*/en')")
def page_search(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    wanted = "blog.*/en"
    return table(spark, sf_dir, "pages").filter(F.coalesce(F.lower("url").rlike(wanted), F.lit(False)) | F.coalesce(F.lower(title).rlike(wanted), F.lit(False))).select("page_id", "url")


@query("SELECT doc_id, lang, CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE pos <= ceil(n * 0.25)")
def fraction_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return allocation.fraction_prefix(docs, ["lang"], ["doc_id"], 0.25).select("doc_id", "lang", "pos")


@query(f"SELECT doc_id FROM {SQL_DOCS} WHERE len(w) >= 40 AND len(regexp_replace(text, '[^\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) / len(text) <= 0.15 AND len(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.5 * len(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))")
def source_items(spark, sf_dir):
    return quality.source_items(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 40, "A-Za-z").select("doc_id")


