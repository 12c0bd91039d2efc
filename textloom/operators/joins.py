"""Joins that equality alone can't say: as-of and overlapping intervals. No task gets a whole key, no plan a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.ranges import ranged


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], tie: str, how: str = "left", strict: bool = False, within: Column | float | None = None, rows: int = 250_000) -> DataFrame:
    """left with the columns `take` of the latest right row of the same `by` that is not after it.

    Of right rows at the same time the one with the largest `tie` counts. `strict`
    wants right rows before the left one, `within` (a length of time or a number)
    none older than that; `how` is left or inner. Null keys and times match
    nothing. The columns `take`, which left must not have, and left's are returned.

    Both sides are put in one order (key, time), cut at sampled bounds into ranges;
    within a range a window carries the last right row forward, and what a range's
    last key had seen is handed to the ranges after it. So a hot key is spread over
    as many tasks as its rows need. Both inputs are read four times.
    """
    known = lambda df, on: df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, on]))
    keys = [F.col(c).alias(f"_k{n}") for n, c in enumerate(by)]
    names = [f"_k{n}" for n in range(len(by))]
    side = F.lit(0 if strict else 2)
    here = known(left, left_on).select(*keys, F.col(left_on).alias("_t"), side.alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_left"))
    there = known(right, right_on).select(*keys, F.col(right_on).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.struct(F.col(right_on).alias("_at"), *take).alias("_right"))
    both = here.unionByName(there, allowMissingColumns=True).withColumn("_h", F.xxhash64("_left", "_right"))  # the hash splits a time that very many rows share
    order = ["_t", "_side", "_tie", "_h"]
    both = ranged(both, [*names, *order], rows=rows)

    in_range = W.partitionBy("_range", *names).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(in_range)).filter("_side <> 1")
    # One row a range: its last key, and the last right row of that key in it.
    last = both.groupBy("_range").agg(F.max(F.struct(*names)).alias("_key"), F.max_by(F.struct(F.struct(*names).alias("key"), F.col("_right").alias("row")), F.when(F.col("_side") == 1, F.struct(*names, *order))).alias("_r"))
    ordered = W.orderBy("_range")
    had = F.when(F.col("_r.key") == F.col("_key"), F.col("_r.row"))
    carried = F.last(had, ignorenulls=True).over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
    handed = last.select("_key", carried.alias("_carried"), F.lead("_range").over(ordered).alias("_range")).filter("_range IS NOT NULL AND _carried IS NOT NULL").select("_range", "_carried", *[F.col(f"_key.{k}") for k in names])
    out = local.join(F.broadcast(handed), ["_range", *names], "left").select("_left", F.coalesce("_seen", "_carried").alias("_right"))  # at most as many rows as ranges
    if within is not None:
        out = out.withColumn("_right", F.when(F.col(f"_left.{left_on}") - within <= F.col("_right._at"), F.col("_right")))
    if how == "inner":
        return out.filter("_right IS NOT NULL").select("_left.*", *[F.col(f"_right.{c}") for c in take])
    bare = left.filter(" OR ".join(f"`{c}` IS NULL" for c in [*by, left_on])).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    return out.select("_left.*", *[F.col(f"_right.{c}") for c in take]).unionByName(bare)


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], empty: bool = False) -> DataFrame:
    """Pairs (struct `l`, struct `r`) of rows with the same `by` whose half-open spans [start, end) overlap.

    Starts and ends are integers (micro-seconds of a time). Rows with a null key,
    start or end match nothing, nor do empty spans, unless `empty`: then all pairs
    with each start before the other's end match, so a span that ends at its start,
    or before it, matches those that go on on both sides of it.

    A span of length up to 2**m has level m and lies in one or two bins of that
    width. Two spans meet at the larger of their levels, in the bin of the later
    start, so each pair comes once, and what meets in a bin is of the order of what
    overlaps there, however different the lengths are. The join is on equal (key,
    level, bin); adaptive execution splits a bin that is crowded.
    """

    def placed(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        s, e = (F.col(c).cast("long") for c in span)
        rows = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, *span]))
        if not empty:
            rows = rows.filter(s < e)
        first, last = F.least(s, e), F.when(s < e, e - 1).otherwise(s)
        return rows.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(by)], s.alias("s"), e.alias("e"), first.alias("f"), last.alias("t"), F.length(F.bin(last - first)).alias("own"), F.struct(*df.columns).alias(name))

    def levels(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select("own").distinct().collect())  # 64 at most

    def binned(df: DataFrame, other: list[int], side: str) -> DataFrame:
        at = F.array_union(F.array("own"), F.filter(F.lit(other).cast("array<int>"), lambda m: m > F.col("own")))
        spread = df.select("*", F.explode(at).alias("level"))
        bins = F.sequence(F.expr("shiftright(f, level)"), F.expr("shiftright(t, level)"))
        return spread.select("*", F.explode(bins).alias("bin")).withColumnsRenamed({"s": f"{side}s", "e": f"{side}e", "f": f"{side}f", "own": f"{side}own"}).drop("t")

    a, b = placed(left, left_span, "l"), placed(right, right_span, "r")
    x, y = binned(a, levels(b), "a"), binned(b, levels(a), "b")
    pairs = x.join(y, [*[f"_k{n}" for n in range(len(by))], "level", "bin"])
    meet = (F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae"))
    once = (F.greatest("aown", "bown") == F.col("level")) & (F.expr("shiftright(greatest(af, bf), level)") == F.col("bin"))
    return pairs.filter(meet & once).select("l", "r")
