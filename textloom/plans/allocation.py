"""Seeded allocation, splits, folds and integrity checks; all by md5 ranks, so SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import allocation
from textloom.plans.registry import query, table

_RANK = "row_number() OVER (ORDER BY md5('{seed}:' || {id}), {id})"
_SLICES = f"(SELECT doc_id, ['m1', 'm2', 'm3'][CAST((rn - 1) // 60 AS INTEGER) + 1] AS model, (rn - 1) % 60 + 1 AS pos FROM (SELECT doc_id, {_RANK.format(seed=42, id='doc_id')} AS rn FROM documents) WHERE rn <= 180)"
_MODES = f"(SELECT *, ntile(2) OVER (PARTITION BY model ORDER BY pos) - 1 AS variant FROM (SELECT doc_id, model, pos, 'mode_a' AS mode FROM {_SLICES} WHERE pos <= 21) UNION ALL SELECT *, ntile(4) OVER (PARTITION BY model ORDER BY pos) - 1 FROM (SELECT doc_id, model, pos, 'mode_b' AS mode FROM {_SLICES} WHERE pos > 21 AND pos <= 51))"
_GROUPS = f"(SELECT conv_id, {_RANK.format(seed=42, id='conv_id')} AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))"


def slices(spark, sf_dir):
    return allocation.model_slices(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", ["m1", "m2", "m3"], 60)


@query(f"SELECT doc_id, model, pos FROM {_SLICES}")
def md5_shuffle_slices(spark, sf_dir):
    return slices(spark, sf_dir).select("doc_id", "model", "pos")


@query(f"SELECT doc_id, model, mode, CAST(variant AS INTEGER) AS variant FROM {_MODES}")
def mode_allocation(spark, sf_dir):
    return allocation.modes(slices(spark, sf_dir), {"mode_a": (21, 2), "mode_b": (30, 4)}, ["model"]).select("doc_id", "model", "mode", "variant")


@query("SELECT l_partkey, count(DISTINCT l_returnflag || '/' || l_linestatus) AS cells FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || '/' || l_linestatus) > 1")
def allocation_overlap(spark, sf_dir):
    return allocation.overlaps(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_returnflag", "l_linestatus"])


@query(f"SELECT c.conv_id, turn, CASE WHEN rn <= ceil(0.25 * n) THEN 'dev' ELSE 'train' END AS split FROM conversations c JOIN {_GROUPS} USING (conv_id)")
def pair_holdout_split(spark, sf_dir):
    return allocation.group_split(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", 0.25).select("conv_id", "turn", "split")


@query(f"SELECT c.conv_id, turn FROM conversations c JOIN {_GROUPS} USING (conv_id) WHERE rn <= 40")
def pair_subsample(spark, sf_dir):
    return allocation.subsample(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", 40)


@query(f"SELECT c.conv_id, turn, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM conversations c JOIN {_GROUPS} USING (conv_id)")
def split_70_15_15(spark, sf_dir):
    return allocation.three_way(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id").select("conv_id", "turn", "split")


@query("SELECT lang AS held_out, doc_id, 'test' AS part FROM documents UNION ALL SELECT l.lang, d.doc_id, 'seen' FROM documents d, (SELECT DISTINCT lang FROM documents) l WHERE d.lang <> l.lang")
def leave_one_out(spark, sf_dir):
    """A fold for each language: all its documents are test, all others are seen."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    folds = d.agg(F.collect_set("lang").alias("folds")).scalar()
    test = d.select(F.col("lang").alias("held_out"), "doc_id", F.lit("test").alias("part"))
    seen = d.filter("lang IS NOT NULL").withColumn("_folds", folds).select(F.explode(F.array_remove("_folds", F.col("lang"))).alias("held_out"), "doc_id", F.lit("seen").alias("part"))
    return test.unionByName(seen)


_SPLIT = f"(SELECT c.conv_id, CASE role WHEN 'user' THEN 0 ELSE 1 END AS label, CASE WHEN turn % 4 = 3 THEN 'late' ELSE 'early' END AS domain, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM conversations c JOIN {_GROUPS} USING (conv_id))"


@query(
    f"""SELECT 'pair_size' AS "check", count(*) FILTER (WHERE n <> 2) AS broken FROM (SELECT conv_id, count(*) AS n FROM {_SPLIT} GROUP BY 1)
    UNION ALL SELECT 'group_leak', count(*) FILTER (WHERE s > 1) FROM (SELECT conv_id, count(DISTINCT split) AS s FROM {_SPLIT} GROUP BY 1)
    UNION ALL SELECT 'label_balance', count(*) FILTER (WHERE a <> b) FROM (SELECT split, count(*) FILTER (WHERE label = 0) AS a, count(*) FILTER (WHERE label = 1) AS b FROM {_SPLIT} GROUP BY 1)
    UNION ALL SELECT 'empty_cell', count(*) FROM (SELECT domain, label FROM (SELECT DISTINCT domain FROM {_SPLIT}), (SELECT DISTINCT label FROM {_SPLIT}) EXCEPT SELECT domain, label FROM {_SPLIT})
    UNION ALL SELECT 'row_count', CAST(count(*) <> 500 AS BIGINT) FROM {_SPLIT}"""
)
def integrity_violations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = allocation.three_way(c, "conv_id").select(F.col("conv_id").alias("group"), F.when(F.col("role") == "user", 0).otherwise(1).alias("label"), F.when(F.col("turn") % 4 == 3, "late").otherwise("early").alias("domain"), "split")
    return allocation.violations(rows, expected=500)


@query(
    """SELECT 'size_' || s.split AS "check", CAST(coalesce(n, 0) <> wanted AS BIGINT) AS broken FROM (VALUES ('train', 700), ('dev', 150), ('test', 150)) s(split, wanted) LEFT JOIN (SELECT split, count(*) AS n FROM """
    + _SPLIT
    + """ GROUP BY split) USING (split)
    UNION ALL SELECT 'punctuation', count(*) FILTER (WHERE role = 'user' AND regexp_matches(replace(text, '<LAT>', ''), '[\\p{P}\\p{S}]')) FROM conversations"""
)
def split_size_and_punctuation_checks(spark, sf_dir):
    """Wanted sizes of the splits, and a domain that must hold no punctuation."""
    rows = allocation.three_way(table(spark, sf_dir, "conversations"), "conv_id").select(F.col("conv_id").alias("group"), F.lit(0).alias("label"), F.col("role").alias("domain"), "split", "text")
    return allocation.violations(rows, sizes={"train": 700, "dev": 150, "test": 150}, unpunctuated="user").filter("check LIKE 'size_%' OR check = 'punctuation'")
