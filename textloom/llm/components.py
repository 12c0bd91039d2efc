"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, materialise


#: Fewer edges than one task holds anyway are joined without a written copy of the minima.
FEW = 100_000


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b) -> (node, label): the smallest node of each component, for every node with an edge.

    Neighbourhoods are never gathered: each round takes minima (combined before
    the shuffle) and joins them back, so a node of any degree is many small rows.
    The minima are written first, so that Spark can split a hub's edges in the join.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(now)
    for _ in range(rounds):
        kept: list[DataFrame] = []

        def apart(low: DataFrame, n: int = before[0], kept: list[DataFrame] = kept) -> DataFrame:
            if n > FEW:
                low = materialise(low, "low")
                kept.append(low)
            return low

        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        then = materialise(small, "edges")
        after = state(then)
        for low in (now, *kept):
            forget(low)
        now, done, before = then, after == before, after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
