"""Global ranks without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators import ranges


def global_rank(df: DataFrame, key: Column, ties: list[str], name: str = "rn", digits: int = 3) -> DataFrame:
    """Rank from 1 by a hexadecimal key and the tie columns.

    Rows are ranked inside the buckets of the key's first digits; the buckets'
    counts (16**digits rows at most) give the offsets.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_before")
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", *ties))
    return keyed.withColumn(name, rank).join(F.broadcast(offsets), "_bucket").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_key", "_bucket", "_before")


def sorted_rank(df: DataFrame, by: list[str], name: str = "rn", rows: int = 250_000) -> DataFrame:
    """Rank from 1 in the order of the columns `by`, nulls first, however their values are spread.

    Rows are ranked inside sampled ranges (operators/ranges.py) of about `rows` rows
    and the ranges' counts give the offsets. With a unique last column no range is
    much larger than another.
    """
    parted = ranges.ranged(df, by, rows=rows)
    before = ranges.with_offsets(parted, {"_before": F.count("*")})
    ranked = parted.withColumn(name, F.row_number().over(W.partitionBy("_range").orderBy(*by)))
    return ranked.join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def shuffle_rank(df: DataFrame, id_col: str, seed: int, name: str = "rn") -> DataFrame:
    """A seeded permutation: rank by md5 of seed and id."""
    return global_rank(df, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), [id_col], name)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (run logs)."""
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def is_best(df: DataFrame, key: str, value: str, name: str = "best") -> DataFrame:
    """Marks the rows at their key's maximum, ties included."""
    return df.withColumn(name, F.col(value) == F.max(value).over(W.partitionBy(key)))


def running_best(df: DataFrame, key: str, order: list[str], value: str, name: str = "improves") -> DataFrame:
    """Marks rows strictly above all earlier ones of their key."""
    before = F.max(value).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn(name, before.isNull() | (F.col(value) > before))
