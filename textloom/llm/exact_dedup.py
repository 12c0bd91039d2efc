"""Exact duplicates by a log-structured merge index of text digests.

* Memtable: each input split is one memtable. It is flushed, without a shuffle, as
  a run: a Parquet file of its (digest, id) entries, sorted by digest.
* Filters: the runs' 64-bit fingerprints of digests are counted. Those that occur
  once can have no copy in any run; the others make a bitmap, sized by their
  number and bounded, that prunes compaction, lookup and verification to entries
  that may have copies.
* Compaction: what the filter lets through is merged fan_in runs at a time,
  keeping per digest the extreme identifier and the count, until one level remains.
* Hits (digests with more than one row) get byte verification: the texts that
  pass the filter are grouped by their own bytes.

Counts and extremes are combined before each shuffle, and in the lookup a hot
digest's entries are dealt over salts, so a text that a third of all rows share
loads no task more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bit_filter, forget, materialise, might_contain, spread_join, text_of

#: The hit filter's bitmap: 16 bits for each hit, within these powers of two (at most 8 MB).
LEAST_BITS, MOST_BITS = 12, 26


def flush(base: DataFrame, digest: Column) -> DataFrame:
    """Level 0: one sorted run for each split; `f` is a digest's fingerprint."""
    entries = base.select(digest.alias("digest"), "id", F.spark_partition_id().cast("long").alias("run")).withColumn("f", F.xxhash64("digest"))
    return materialise(entries.sortWithinPartitions("digest"), "runs")


def hit_filter(level0: DataFrame) -> tuple[Column, int]:
    """(bitmap, its log2 bits) of the fingerprints that occur more than once in the runs."""
    hits = materialise(level0.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1").select("f"), "hits")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * hits.count()).bit_length()))
    return bit_filter(hits, "f", bits).scalar(), bits


def compact(entries: DataFrame, keep: str, fan_in: int) -> DataFrame:
    """Merges runs, fan_in at a time, down to one entry per digest."""
    extreme = F.max if keep == "max" else F.min
    runs = entries.agg(F.max("run")).first()[0] or 0
    level = entries.select("run", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    while True:
        runs //= fan_in
        level = level.withColumn("run", F.expr(f"run div {fan_in}")).groupBy("run", "digest").agg(extreme("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        if not runs:
            return level.select("digest", "keep_id", F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 64, digest_bits: int = 256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null and '' are copies of each other. Of equal
    texts the row with the largest (keep='min': smallest) id stays. Rows that
    repeat both id and text get the same answer. No rows in, no rows out. Only
    the two named columns are read, so other columns can have any name. Null ids
    count in group_size and never stay unless the whole group has none.
    digest_bits below 256 cuts the digest (to test collisions); results do not change.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    sha = F.sha2("text", 256)
    digest = F.unhex(F.substring(sha, 1, digest_bits // 4))
    extreme = F.max if keep == "max" else F.min
    level0 = flush(base, digest)
    words, bits = hit_filter(level0)
    passes = might_contain(words, F.col("f"), bits)
    index = materialise(compact(level0.filter(passes), keep, fan_in), "index")
    texts = base.select("id", digest.alias("digest"), "text").withColumn("f", F.xxhash64("digest")).filter(passes)
    variants = texts.groupBy("digest", "text").agg(extreme("id").alias("keep_id"), F.count("*").alias("group_size"))
    bad = materialise(variants.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1").select("digest"), "collisions")

    one = F.lit(1).cast("long").alias("group_size")
    cols = ["id", "keep_id", "group_size", "text_sha256"]
    if digest_bits == 256 and bad.isEmpty():
        forget(bad)
        alone = level0.filter(~passes).select("id", F.col("id").alias("keep_id"), one, "digest")
        met = spread_join(level0.filter(passes).select("digest", "id", "run"), index, ["digest"], "group_size", ["id", "run"])
        rows = alone.unionByName(met.select("id", "keep_id", "group_size", "digest")).withColumn("text_sha256", F.lower(F.hex("digest")))
    else:  # different texts with one digest: their rows are told apart by the texts themselves
        full = base.select("id", digest.alias("digest"), "text", sha.alias("text_sha256"))
        plain = full.join(bad, "digest", "left_anti").join(compact(level0, keep, fan_in), "digest")
        mended = full.join(bad, "digest", "left_semi").join(variants, ["digest", "text"])
        rows = plain.select(*cols).unionByName(mended.select(*cols))
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one row with the largest id.

    Of rows that repeat an id and its text one stays, and one of equal texts whose
    ids are all null. Only rows that the filter takes for possible copies are shuffled.
    """
    keyed = docs.withColumns({"_textloom_text": text_of(text_col), "_textloom_id": F.col(id_col)})
    digest = F.unhex(F.sha2("_textloom_text", 256))
    words, bits = hit_filter(flush(keyed.select(F.col("_textloom_id").alias("id"), "_textloom_text"), digest))
    passes = might_contain(words, F.xxhash64(digest), bits)
    rank = F.struct(F.col("_textloom_id").isNotNull(), "_textloom_id")
    met = keyed.filter(passes).groupBy("_textloom_text").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias("_textloom_row"))
    return keyed.filter(~passes).select(*docs.columns).unionByName(met.select("_textloom_row.*"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
