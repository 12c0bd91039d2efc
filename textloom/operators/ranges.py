"""Ranges of a whole sort order, drawn from a sample: no task sees all rows, and no hot key is one task."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import cut


def range_of(point: Column, bounds: Column, most: int) -> Column:
    """How many of the sorted bounds (at most `most`) are <= point, by binary search."""
    steps = F.lit([1 << i for i in reversed(range(max(1, most.bit_length())))])

    def step(at: Column, size: Column) -> Column:
        bound = F.get(bounds, at + size - 1)
        return F.when(bound.isNotNull() & (bound <= point), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def ranged(df: DataFrame, by: list[str], name: str = "_range", rows: int = 250_000, most: int = 4096, sample: int = 64) -> DataFrame:
    """df with the number of each row's range in the order of the columns `by` (nulls first), about `rows` rows a range.

    At most `most` ranges, `sample` drawn rows each, so what the sample holds has a
    fixed bound. Rows with equal keys share a range: end `by` with a unique column
    to split a hot key. df is read twice more, so it should be cheap or written.
    """
    count = df.count()
    parts = min(most, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // rows)))
    if parts < 2 or count < 2:
        return df.withColumn(name, F.lit(0))
    drawn = df.filter(F.rand(1729) < min(1.0, parts * sample / count)).select(F.struct(*by).alias("k")).agg(F.sort_array(F.collect_list("k")).alias("k"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("k", F.floor(i * F.size("k") / parts).cast("int")))
    picked = drawn.select(F.array_distinct(F.filter(cuts, lambda b: b.isNotNull())).alias("b"))
    # the drawn bounds are fixed here: each plan that reads the result then has the same ones
    fixed = df.sparkSession.createDataFrame(picked.toArrow(), schema=picked.schema)
    return df.withColumn("_bounds", fixed.scalar()).withColumn(name, range_of(F.struct(*by), F.col("_bounds"), parts)).drop("_bounds")


def with_offsets(df: DataFrame, sums: dict[str, Column], range_col: str = "_range") -> DataFrame:
    """One row per range: for each name, the sum of that aggregate over all ranges before it. At most as many rows as ranges."""
    per = df.groupBy(range_col).agg(*[c.alias(k) for k, c in sums.items()]).collect()
    rows, at = [], dict.fromkeys(sums, 0)
    for r in sorted(per, key=lambda r: r[range_col]):
        rows.append({range_col: r[range_col], **at})
        at = {k: at[k] + (r[k] or 0) for k in sums}
    kinds = ", ".join(f"{k} bigint" for k in sums)
    return df.sparkSession.sql(f"SELECT inline(from_json(:s, 'array<struct<{range_col}: int, {kinds}>>'))", args={"s": json.dumps(rows)})


def same(a: str, b: str, keys: list[str]) -> Column:
    """Equality of the aliases a and b on all keys, nulls equal."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def sums_before(parted: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """For each group and range: of each column, its sum `_in_<name>` there, `_before_<name>` in the group's earlier ranges, `_all_<name>` in the group."""
    per = parted.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_in_{k}") for k, c in sums.items()])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # ranges of one group: as many as there are ranges
    earlier = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return per.select("*", *[F.coalesce(F.sum(f"_in_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums], *[F.sum(f"_in_{k}").over(group).alias(f"_all_{k}") for k in sums])


def prefix_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], rows: int = 250_000) -> DataFrame:
    """df with, for each name and column of `sums`, the sum `<name>_before` over its group's earlier rows and `<name>_all` over the whole group.

    The columns `order` must be unique in a group of the columns `by` (none: one
    group). Sums run inside sampled ranges of (group, order), to which the sums of
    the group's earlier ranges are added, so a group with all rows is many tasks.
    """
    parted = ranged(cut(df), [*by, *order], rows=rows)
    local = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    here = parted.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_here_{k}") for k, c in sums.items()])
    joined = here.alias("x").join(sums_before(parted, by, sums).alias("y"), same("x", "y", [*by, "_range"]))
    return joined.select(*[f"x.{c}" for c in df.columns], *[(F.col(f"x._here_{k}") + F.col(f"y._before_{k}")).alias(f"{k}_before") for k in sums], *[F.col(f"y._all_{k}").alias(f"{k}_all") for k in sums])


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], rows: int = 250_000) -> DataFrame:
    """Exact quantiles of each group, linearly interpolated: by, n (values), q (array in the order of `at`).

    Null values are left out; a group without values is missing. Equal values are
    counted first. Sampled ranges of (group, value) and their counts tell which
    ranges hold the wanted ranks, and only these are sorted.
    """
    counted = cut(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")))
    parted = ranged(counted, [*by, "_v"], rows=rows)
    known = sums_before(parted, by, {"n": "_c"})
    exact = F.lit([float(q) for q in at])
    place = F.transform(exact, lambda q: q * (F.col("_all_n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(place, lambda p: F.array(F.floor(p), F.ceil(p)))))
    wanted = known.select(*by, "_range", "_before_n", "_all_n", F.filter(ranks, lambda r: (r >= F.col("_before_n")) & (r < F.col("_before_n") + F.col("_in_n"))).alias("_ranks")).filter(F.size("_ranks") > 0)
    some = parted.alias("x").join(wanted.alias("y"), same("x", "y", [*by, "_range"])).select(*[f"x.{c}" for c in [*by, "_range", "_v", "_c"]], "_before_n", "_all_n", "_ranks")
    upto = F.col("_before_n") + F.sum("_c").over(W.partitionBy(*by, "_range").orderBy("_v"))
    hit = some.withColumn("_upto", upto).withColumn("_ranks", F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")))).filter(F.size("_ranks") > 0)
    found = hit.groupBy(*by).agg(F.first("_all_n").alias("n"), F.flatten(F.collect_list(F.transform("_ranks", lambda r: F.struct(r.alias("r"), F.col("_v").cast("double").alias("v"))))).alias("_f"))  # two ranks a quantile
    at_rank = F.map_from_entries("_f")

    def between(q: Column) -> Column:
        p = q * (F.col("n") - 1)
        low, high = F.element_at(at_rank, F.floor(p)), F.element_at(at_rank, F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*by, "n", F.transform(exact, between).alias("q"))


def distribution_ranks(df: DataFrame, by: list[str], value: str, rows: int = 250_000) -> DataFrame:
    """df with rank, dense_rank, percent_rank and cume_dist of `value` in its group, nulls first, ties alike.

    Counts of the distinct values get prefix sums over ranges; rows look them up by
    (group, value), so no task sorts a group.
    """
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_c"), F.lit(1).cast("long").alias("_one"))
    per = prefix_sums(counted, by, [value], {"n": "_c", "d": "_one"}, rows)
    rank = F.col("n_before") + 1
    per = per.select(
        *by, value, rank.alias("rank"), (F.col("d_before") + 1).alias("dense_rank"), F.when(F.col("n_all") > 1, (rank - 1) / (F.col("n_all") - 1)).otherwise(0.0).alias("percent_rank"), ((F.col("n_before") + F.col("_c")) / F.col("n_all")).alias("cume_dist"),
    )
    return df.alias("x").join(per.alias("y"), same("x", "y", [*by, value])).select("x.*", "rank", "dense_rank", "percent_rank", "cume_dist")


def merged(kind: str, a: Column, b: Column) -> Column:
    """An aggregate over two sets of rows from those over each."""
    if kind in ("min", "max"):
        return (F.least if kind == "min" else F.greatest)(a, b)
    return F.coalesce(a + b, a, b)


def kind_of(agg: Column) -> str | None:
    """count, sum, min or max, if that is what a column is; else None."""
    found = re.match(r"Column<'(count|sum|min|max)\(", str(agg))
    return found[1] if found and str(agg).count("(") == 1 else None


def range_frame(df: DataFrame, by: list[str], order: str, width: int, aggs: dict[str, Column]) -> DataFrame:
    """df with aggregates over the rows of the group whose `order` is in [own - width, own] (RANGE frame).

    `order` is an integer (micro-seconds of a time); rows without one, or without a
    group key, get the aggregates over their peers. Rows lie in bins of `width`, so
    a group is as many tasks as it has bins. A frame is the end of one bin and the
    start of the next: each bin is aggregated once from either side, and the end is
    looked up, so time is linear however many rows a frame holds. This goes for
    count, sum, min and max of a column; with any other aggregate, rows are seen
    from the next bin too and each frame is gone through.
    """
    at = F.col(order).cast("long")
    bin_ = F.floor(at / F.lit(width)) if width > 1 else at
    kinds = {k: kind_of(c) for k, c in aggs.items()}
    if width < 1 or None in kinds.values():
        bins = F.when(at.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(bin_, bin_ + 1))
        spread = df.select("*", F.posexplode(bins).alias("_late", "_bin"))
        frame = W.partitionBy(*by, "_bin").orderBy(F.col(order).cast("long")).rangeBetween(-width, 0)
        return spread.select("*", *[c.over(frame).alias(k) for k, c in aggs.items()]).filter("_late = 0").drop("_late", "_bin")
    group = W.partitionBy(*by, "_bin")
    start, end = (group.orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (at, at.desc()))
    both = df.withColumn("_bin", bin_).select("*", *[F.struct(*[c.over(w).alias(k) for k, c in aggs.items()]).alias(name) for name, w in (("_start", start), ("_end", end))])
    # each row looks up, in the bin before, the first row that its frame holds
    ask = F.struct(F.lit(True).alias("ask"), (at - width).alias("t"), (F.col("_bin") - 1).alias("bin"))
    tell = F.struct(F.lit(False).alias("ask"), at.alias("t"), F.col("_bin").alias("bin"))
    wide = both.select(*df.columns, "_start", "_end", F.explode(F.when(at.isNull(), F.array(ask)).otherwise(F.array(ask, tell))).alias("_p"))
    slim = wide.select(*by, F.col("_p.bin").alias("_bin"), F.col("_p.t").alias("_t"), F.col("_p.ask").alias("_ask"), F.when(F.col("_p.ask"), F.struct(*df.columns)).alias("_row"), F.when(F.col("_p.ask"), F.col("_start")).alias("_start"), F.when(~F.col("_p.ask"), F.col("_end")).alias("_end"))
    found = slim.withColumn("_end", F.last("_end", ignorenulls=True).over(group.orderBy(F.col("_t").desc(), "_ask").rowsBetween(W.unboundedPreceding, 0))).filter("_ask")
    return found.select("_row.*", *[merged(kinds[k], F.col(f"_start.{k}"), F.col(f"_end.{k}")).alias(k) for k in aggs])
