"""Mergeable sketches: state stored per day (or any part of the data) and merged later, with stated errors.

Distinct counts are HyperLogLog with 2**lg_k registers: relative standard error
1.04 / sqrt(2**lg_k). Quantiles are KLL sketches: a rank off by about 2.3 / k**0.9
of all rows at most (99 % of cases). Both come from Spark's own aggregates, which
combine before the shuffle; a state has a fixed size whatever it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 200


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = K) -> float:
    """Share of all rows that a quantile's rank may be off."""
    return 2.3 / k**0.9


def sketch(df: DataFrame, by: list[str], distinct: str, value: str, lg_k: int = LG_K, k: int = K) -> DataFrame:
    """State of each group: by, n (rows), hll (of `distinct`), kll (of the numbers `value`). Nulls are not seen by the sketches."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, lg_k).alias("hll"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("kll"))


def merge(states: DataFrame, by: list[str]) -> DataFrame:
    """States of larger groups from those of smaller ones; merging in steps or at once sees the same rows."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))


def estimates(states: DataFrame, at: list[float]) -> DataFrame:
    """The state's columns with n_distinct and, where values were seen, the quantiles q (array in the order of `at`)."""
    seen = F.kll_sketch_get_n_double("kll") > 0
    quantiles = F.kll_sketch_get_quantile_double("kll", F.lit([float(a) for a in at]))
    return states.withColumn("n_distinct", F.hll_sketch_estimate("hll")).withColumn("q", F.when(seen, quantiles)).drop("hll", "kll")


def add_day(old: DataFrame | None, rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """The stored states with the rows of a further day merged in; only the new rows are read."""
    new = sketch(rows, by, distinct, value)
    return merge(new if old is None else old.unionByName(new), by)
