"""Joins, quantiles, ranks and sums over sampled ranges, against DuckDB on skewed rows."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import joins, pairs, ranges, sketches, stats

PER = 40  # rows a range: many ranges, and a hot key that covers many of them


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def clean(v):
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


def same_rows(df, sql, **frames):
    con = duckdb.connect()
    for name, f in frames.items():
        con.register(name, f)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    cols = df.columns
    theirs = [tuple(clean(v) for v in r) for r in want.project(", ".join(cols)).fetchall()]
    ours = [tuple(clean(v) for v in r) for r in df.collect()]
    assert sorted(ours, key=key) == sorted(theirs, key=key)
    return len(ours)


@pytest.fixture(scope="module")
def rows():
    """A third of the rows have key 0; values tie, some are null."""
    rng = random.Random(21)
    out = []
    for i in range(1500):
        k = None if rng.random() < 0.02 else 0 if rng.random() < 0.33 else rng.randrange(1, 30)
        t = None if rng.random() < 0.02 else rng.randrange(600)
        v = None if rng.random() < 0.05 else 7.0 if rng.random() < 0.3 else round(rng.gauss(0, 100), 1)
        out.append((i, k, t, v))
    return pd.DataFrame(out, columns=["i", "k", "t", "v"]).astype({"k": "Int64", "t": "Int64", "v": "Float64"})


KIND = "i long, k long, t long, v double"


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), KIND).repartition(6)


ASOF = """WITH r AS (SELECT k, t AS rt, max(i) AS ri FROM rows WHERE i % 4 = 0 AND k IS NOT NULL AND t IS NOT NULL GROUP BY ALL), l AS (SELECT i, k, t FROM rows WHERE i % 4 > 0)
SELECT l.i, r.ri FROM l {how} JOIN r ON l.k = r.k AND r.rt = (SELECT max(rt) FROM r AS x WHERE x.k = l.k AND x.rt {op} l.t) {more}"""


@pytest.mark.parametrize(("args", "how", "op", "more"), [({}, "LEFT", "<=", ""), ({"how": "inner"}, "INNER", "<=", ""), ({"strict": True}, "LEFT", "<", ""), ({"within": 3}, "LEFT", "<=", "AND l.t - r.rt <= 3")])
def test_asof_join(df, rows, args, how, op, more):
    left, right = df.filter("i % 4 > 0").select("i", "k", "t"), df.filter("i % 4 = 0").select(F.col("i").alias("ri"), "k", F.col("t").alias("rt"))
    got = joins.asof_join(left, right, ["k"], "t", "rt", ["ri"], "ri", rows=PER, **args)
    assert same_rows(got.select("i", "ri"), ASOF.format(how=how, op=op, more=more), rows=rows) > 500


def test_asof_join_spreads_one_time(spark):
    """All rows at one time of one key, one right row far before them in another range."""
    left = spark.createDataFrame([(i, 1, 50) for i in range(1000)], "i int, k int, t int")
    right = spark.createDataFrame([(1, 1, 8), (2, 1, 5), (3, 1, 51), (4, 2, 1), (5, 0, 50)], "ri int, k int, rt int")
    got = joins.asof_join(left, right, ["k"], "t", "rt", ["ri"], "ri", rows=PER)
    assert {tuple(r) for r in got.select("k", "ri").distinct().collect()} == {(1, 1)} and got.count() == 1000
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    assert joins.asof_join(left.limit(0), right, ["k"], "t", "rt", ["ri"], "ri").count() == 0
    assert joins.asof_join(left, right.limit(0), ["k"], "t", "rt", ["ri"], "ri").filter("ri IS NULL").count() == 1000


def plan(df):
    return df._jdf.queryExecution().toString()


def test_interval_join(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        k = None if rng.random() < 0.02 else 0 if rng.random() < 0.4 else rng.randrange(1, 8)
        s = None if rng.random() < 0.02 else rng.randrange(-3000, 3000)
        e = None if s is None or rng.random() < 0.02 else s + rng.choice([0, -3, 1, 1, 2, 3, 4, 5, 8, 9, 60, 64, 65, 2000, 10**13])
        rows.append((i, k, s, e))
    df = spark.createDataFrame(rows, "i int, k int, s long, e long").repartition(5)
    a, b = df.filter("i % 3 > 0"), df.filter("i % 3 = 0").withColumnsRenamed({"s": "s2", "e": "e2"})
    got = joins.interval_join(a, b, ["k"], ("s", "e"), ("s2", "e2"))
    text = plan(got)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    frame = pd.DataFrame(rows, columns=["i", "k", "s", "e"]).astype("Int64")
    n = same_rows(got.select(F.col("l.i").alias("a"), F.col("r.i").alias("b")), "SELECT x.i AS a, y.i AS b FROM rows x JOIN rows y ON x.k = y.k AND x.i % 3 > 0 AND y.i % 3 = 0 AND x.s < x.e AND y.s < y.e AND x.s < y.e AND y.s < x.e", rows=frame)
    assert n > 1000
    assert joins.interval_join(a, b.limit(0), ["k"], ("s", "e"), ("s2", "e2")).count() == 0


def test_interval_join_of_empty_spans(spark):
    """With `empty`, spans that end at their start or before it match as the plain comparison says."""
    rng = random.Random(8)
    rows = [(i, i % 2, s, s + rng.choice([0, 0, -1, -3, -40, 1, 2, 8, 30, 200])) for i in range(500) for s in [rng.randrange(-300, 300)]]
    df = spark.createDataFrame(rows, "i int, k int, s long, e long").repartition(5)
    got = joins.interval_join(df.filter("i % 3 > 0"), df.filter("i % 3 = 0"), ["k"], ("s", "e"), ("s", "e"), empty=True)
    frame = pd.DataFrame(rows, columns=["i", "k", "s", "e"])
    sql = "SELECT x.i AS a, y.i AS b FROM rows x JOIN rows y ON x.k = y.k AND x.i % 3 > 0 AND y.i % 3 = 0 AND x.s < y.e AND y.s < x.e"
    assert same_rows(got.select(F.col("l.i").alias("a"), F.col("r.i").alias("b")), sql, rows=frame) > 1000


def test_interval_join_meets_little_in_vain(spark):
    """Long spans on one side don't put short ones into one bin."""
    short = spark.range(3000).selectExpr("0 AS k", "id * 1000 AS s", "id * 1000 + 10 AS e")
    long_ = spark.range(30).selectExpr("0 AS k", "id * 100000 AS s2", "id * 100000 + 100000 AS e2")
    got = joins.interval_join(short, long_, ["k"], ("s", "e"), ("s2", "e2"))
    assert got.count() == 3000
    assert joins.interval_join(short, short.withColumnsRenamed({"s": "s2", "e": "e2"}), ["k"], ("s", "e"), ("s2", "e2")).count() == 3000


def test_quantiles(df, rows):
    got = ranges.quantiles(df, ["k"], "v", [0, 0.1, 0.5, 0.975, 1], rows=PER)
    assert same_rows(got.select("k", "n", *[F.col("q")[j].alias(f"q{j}") for j in range(5)]), f"SELECT k, count(v) AS n, {', '.join(f'quantile_cont(v, {q}) AS q{j}' for j, q in enumerate([0, 0.1, 0.5, 0.975, 1]))} FROM rows WHERE v IS NOT NULL GROUP BY k", rows=rows) > 25
    whole = stats.percentile_ci(df, [], "v", rows=PER)
    same_rows(whole, "SELECT quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM rows WHERE v IS NOT NULL", rows=rows)
    assert ranges.quantiles(df.filter("v IS NULL"), ["k"], "v", [0.5]).count() == 0


def test_ranges_split_a_hot_key(df):
    sizes = [r[1] for r in ranges.ranged(df, ["k", "t", "i"], rows=PER).groupBy("_range").count().collect()]
    assert len(sizes) > 25 and max(sizes) < 4 * PER


def test_median_cube(df, rows):
    by = df.withColumn("a", F.col("k") % 3).withColumn("b", (F.col("i") % 2).cast("string"))
    got = pairs.summarise(by.select("a", "b", "v"), ["a", "b"], ["v"], rows=PER)
    same_rows(got, "SELECT k % 3 AS a, CAST(i % 2 AS VARCHAR) AS b, count(*) AS n, avg(v) AS v_mean, stddev_samp(v) AS v_sd, median(v) AS v_median FROM rows GROUP BY CUBE (a, b)", rows=rows)
    same_rows(pairs.summarise(df.select("v"), [], ["v"], rows=PER), "SELECT count(*) AS n, avg(v) AS v_mean, stddev_samp(v) AS v_sd, median(v) AS v_median FROM rows", rows=rows)


def test_auc(spark, df, rows):
    sql = "SELECT k, (sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2) / nullif(p * q, 0) AS auc FROM (SELECT *, count(*) FILTER (WHERE y = 1) OVER (PARTITION BY k) AS p, count(*) FILTER (WHERE y = 0) OVER (PARTITION BY k) AS q, "
    sql += "rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2 AS r FROM (SELECT {k} AS k, v, i % 2 AS y FROM rows WHERE v IS NOT NULL)) GROUP BY k, p, q"
    scored = df.filter("v IS NOT NULL").withColumn("y", F.col("i") % 2)
    same_rows(stats.roc_auc(scored, ["k"], "y", "v", rows=PER), sql.format(k="k"), rows=rows)
    same_rows(stats.roc_auc(scored, [], "y", "v", rows=PER), f"SELECT auc FROM ({sql.format(k=1)})", rows=rows)


def test_auc_of_a_million_distinct_scores(spark):
    """One group; the label depends on the score's parity so that the area is known."""
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("s"), (F.col("id") * 7919 % n % 2).alias("y"))
    want = sum(i + 1 for i in range(n // 2)) / (n // 2) ** 2
    assert abs(stats.roc_auc(df, [], "y", "s").first()["auc"] - want) < 1e-9


@pytest.mark.parametrize("by", [[], ["k"]])
def test_distribution_ranks(df, rows, by):
    w = f"({'PARTITION BY k ' if by else ''}ORDER BY v NULLS FIRST)"
    got = ranges.distribution_ranks(df.select("i", "k", "v"), by, "v", rows=PER).drop("k", "v")
    same_rows(got, f"SELECT i, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist FROM rows WINDOW w AS {w}", rows=rows)


@pytest.mark.parametrize("width", [1, 25])
def test_range_frame(df, rows, width):
    got = ranges.range_frame(df.select("i", "k", "t", "v"), ["k"], "t", width, {"n": F.count("*"), "top": F.max("v")}).drop("k", "t", "v")
    same_rows(got, f"SELECT i, count(*) OVER w AS n, max(v) OVER w AS top FROM rows WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST RANGE BETWEEN {width} PRECEDING AND CURRENT ROW)", rows=rows)


def test_range_frame_is_linear(df, rows):
    """Counts, sums, least and largest of a frame come from growing frames, which aren't gone through anew for every row; other aggregates are right too."""
    aggs = {"n": F.count("*"), "c": F.count("v"), "s": F.sum("v"), "low": F.min("v"), "top": F.max("v")}
    got = ranges.range_frame(df.select("i", "k", "t", "v"), ["k"], "t", 25, aggs).drop("k", "t", "v")
    assert "RangeFrame, -25" not in plan(got)
    w = "WINDOW w AS (PARTITION BY k ORDER BY t NULLS FIRST RANGE BETWEEN 25 PRECEDING AND CURRENT ROW)"
    same_rows(got, f"SELECT i, count(*) OVER w AS n, count(v) OVER w AS c, sum(v) OVER w AS s, min(v) OVER w AS low, max(v) OVER w AS top FROM rows {w}", rows=rows)
    mean = ranges.range_frame(df.select("i", "k", "t", "v"), ["k"], "t", 25, {"m": F.avg("v"), "d": F.sum(F.abs("v"))}).drop("k", "t", "v")
    same_rows(mean, f"SELECT i, avg(v) OVER w AS m, sum(abs(v)) OVER w AS d FROM rows {w}", rows=rows)


def test_sketches(spark):
    """Day by day or at once: the same estimates of distinct values, quantiles inside the stated error."""
    n = 60_000
    df = spark.range(n).selectExpr("id % 6 AS day", "id % 2 AS g", "id * 31 % 20011 AS who", "CASE WHEN id % 50 = 0 THEN NULL ELSE pow(id * 7919 % 60000, 2) END AS v")
    stored = None
    for day in range(6):
        stored = sketches.add_day(stored, df.filter(F.col("day") == day), ["g"], "who", "v")
    once = sketches.merge(sketches.sketch(df, ["g", "day"], "who", "v"), ["g"])
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    steps, whole = ({r["g"]: r for r in sketches.estimates(s, at).collect()} for s in (stored, once))
    truth = {g: sorted(r[0] for r in df.filter(f"g = {g} AND v IS NOT NULL").select("v").collect()) for g in (0, 1)}
    for g in (0, 1):
        assert steps[g]["n"] == whole[g]["n"] == n // 2 and steps[g]["n_distinct"] == whole[g]["n_distinct"]
        exact = df.filter(f"g = {g}").select("who").distinct().count()
        assert abs(steps[g]["n_distinct"] / exact - 1) < 4 * sketches.distinct_error()
        for r in (steps[g], whole[g]):
            for q, v in zip(at, r["q"], strict=True):
                assert abs(sum(x <= v for x in truth[g]) / len(truth[g]) - q) < 3 * sketches.rank_error()
    empty = sketches.estimates(sketches.sketch(df.filter("v IS NULL"), ["g"], "who", "v"), at).collect()
    assert all(r["q"] is None and r["n"] > 0 for r in empty)
