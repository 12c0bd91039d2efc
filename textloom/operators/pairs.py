"""Pairs of texts: join, ratios, cosine, summaries at several groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.ranges import quantiles, same


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each assistant turn with the user turn just before it: conv_id, turn, src_text, text."""
    w = W.partitionBy("conv_id").orderBy("turn")
    both = conversations.select("conv_id", "turn", "role", "text", F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("src_text"))
    return both.filter("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "src_text", "text")


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by."""
    return part / F.nullif(whole, F.lit(0))


def summarise(df: DataFrame, by: list[str], values: list[str], median: bool = True, rows: int = 250_000) -> DataFrame:
    """n (all rows) and mean, sample deviation and median of each value (nulls skipped), at every grouping of `by`.

    Medians are selected over ranges of the values of all groupings together, so not even the grand total is one task.
    """
    out = [F.count("*").alias("n")]
    for v in values:
        out += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd")]
    if not median:
        return (df.cube(*by) if by else df).agg(*out)
    if not by:
        df, by, bare = df.withColumn("_all", F.lit(1)), ["_all"], True
    else:
        bare = False
    level = F.grouping_id().alias("_level") if not bare else F.lit(0).cast("long").alias("_level")
    whole = (df.groupBy(*by) if bare else df.cube(*by)).agg(level, *out)
    spread = df if bare else df.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(by)) - 1)).cast("array<bigint>")).alias("_level"))
    if bare:
        spread = spread.withColumn("_level", F.lit(0).cast("long"))
    # bit k of the level, from the left, says that column k is summed over
    keys = [F.when(F.col("_level").bitwiseAND(1 << (len(by) - 1 - k)) == 0, F.col(c)).alias(c) for k, c in enumerate(by)]
    found = whole
    for v in values:
        mid = quantiles(spread.select("_level", *keys, F.col(v).alias("_value")), ["_level", *by], "_value", [0.5], rows).withColumn("_median", F.col("q")[0])
        found = found.alias("x").join(mid.alias("y"), same("x", "y", ["_level", *by]), "left").select("x.*", F.col("y._median").alias(f"{v}_median"))
    cols = [c for v in values for c in (f"{v}_mean", f"{v}_sd", f"{v}_median")]
    return found.select(*([] if bare else by), "n", *cols)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def normalised(a: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9))
    return F.transform(a, lambda x: x.cast("double") / norm)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of an array of vectors where the mask is 1, L2-normalised."""
    width = F.size(vectors[0])
    total = F.aggregate(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.cast("double").alias("m"))), F.array_repeat(F.lit(0.0), width), lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q.cast("double") * x["m"]))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    return normalised(F.transform(total, lambda x: x / count))


def greedy_f1(a: Column, b: Column) -> Column:
    """Greedy token matching of two arrays of unit token vectors: F1 of best cosines each way."""
    best = lambda x, y: F.aggregate(F.transform(x, lambda v: F.array_max(F.transform(y, lambda w: dot(v, w)))), F.lit(0.0), lambda s, c: s + c) / F.size(x)
    p, r = best(a, b), best(b, a)
    return 2 * p * r / F.nullif(p + r, F.lit(0.0))


def propagate(df: DataFrame, group: str, condition: Column, value: str, name: str) -> DataFrame:
    """The value of the group's row that meets the condition, on every row of the group."""
    known = df.filter(condition).groupBy(group).agg(F.min(value).alias(name))
    return df.join(known, group, "left")
