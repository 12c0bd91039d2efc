"""Shards of near-equal bytes by sampled splitters.

Rows are ordered by (hash of the text, id), so equal texts lie together. A
sample whose chances are proportional to size gives quantile boundaries; ranges
that turn out overfull are sampled again, more densely, and subdivided. A text
whose rows together are too large for one place takes boundaries between its own
ids; no boundary falls inside any other text's rows. Running sums inside the ranges
then place every row exactly.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import materialise, text_of

#: A group of equal texts stays whole unless it is over this share of a shard.
WHOLE = 0.04
#: Ranges at most, and with them boundaries, sums and sampled rows on the driver.
RANGES = 4096


def range_of(point: Column, bounds: Column, n_bounds: int) -> Column:
    """How many boundaries are <= point, by binary search."""
    steps = F.lit([1 << i for i in reversed(range(max(1, n_bounds.bit_length())))])

    def step(at: Column, size: Column) -> Column:
        bound = F.get(bounds, at + size - 1)
        return F.when(bound.isNotNull() & (bound <= point), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def quantiles(sample: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    sample = sorted(sample)
    return [sample[i * len(sample) // n] for i in range(1, n)] if sample else []


def boundaries(cuts: list[tuple[int, int]], hot: set[int]) -> list[tuple[int, int]]:
    """Cuts moved before the first row of their text; only a hot text keeps those between its ids."""
    return sorted({(key, at) if i and key in hot and cuts[i - 1][0] == key else (key, -(1 << 63)) for i, (key, at) in enumerate(cuts)})


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 8, sample_per_range: int = 48, rows_per_range: int = 1_000_000) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    law is `bytes`: shards differ by at most a large row or WHOLE of a shard.
    size: UTF-8 bytes plus 8; a null text has size 8 and the crc32 of no bytes.
    Equal texts share a shard unless together they exceed WHOLE of one. Slots are
    gapless from 0; rows that repeat id and text get neighbouring slots in either
    order. Ids must be integers; a null id sorts first. Empty input, no rows. Only
    the two named columns are read. There are ranges_per_shard ranges a shard, and
    so many that each, sorted by one task, has about rows_per_range rows, but no
    more than RANGES: a range grows with the table from there on.
    """
    spark = docs.sparkSession
    base = materialise(
        docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
        .select("id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("crc"), F.xxhash64("text").alias("key")),
        "sizes",
    )
    point = F.struct("key", F.coalesce("id", F.lit(-(1 << 63) + 1)).alias("id"))
    total, count = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n = max(shards * ranges_per_shard, min(RANGES, -(-count // rows_per_range)))
    chance = (F.pmod(F.xxhash64("id", "key", F.lit(77)), F.lit(1 << 40)) / float(1 << 40)).alias("u")

    def sample(rows: DataFrame, rate: float) -> list[tuple[int, int]]:
        """Bounded: `rate` makes its expected number of rows a parameter, not a share of the data."""
        return [(r[0], r[1]) for r in rows.filter(chance < F.col("size") * rate).select(point.alias("p")).select("p.key", "p.id").collect()]

    def ranged(bounds: list[tuple[int, int]]) -> DataFrame:
        at = F.from_json(F.lit(json.dumps([{"key": k, "id": i} for k, i in bounds])), "array<struct<key:bigint,id:bigint>>")
        return base.withColumn("range", range_of(point, at, len(bounds)))

    def pick(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Boundaries of the cuts; texts cut twice or more, n at most, are summed whole to see which are too large for one place."""
        twice = sorted({b[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a[0] == b[0]})
        if not twice:
            return boundaries(cuts, set())
        asked = spark.sql("SELECT explode(from_json(:s, 'array<bigint>')) AS key", args={"s": json.dumps(twice)})
        sums = base.join(F.broadcast(asked), "key").groupBy("key").agg(F.sum("size").alias("s")).filter(F.col("s") > WHOLE * total / shards)
        return boundaries(cuts, {r[0] for r in sums.select("key").collect()})

    bounds = pick(quantiles(sample(base, n * sample_per_range / max(1, total)), n))
    for _ in range(3):
        rows = ranged(bounds)
        sums = {r[0]: r[1] for r in rows.groupBy("range").agg(F.sum("size"), F.count("*")).filter("count(1) > 1").collect()}
        over = {r: b for r, b in sums.items() if b > 2 * total / n}
        if not over:
            break
        dense = [r[0] for r in ranged(bounds).filter(F.col("range").isin(*over) & (chance < F.col("size") * (4 * n * sample_per_range / total))).select(F.struct("range", point.alias("p"))).collect()]
        finer = pick([c for r, size in sorted(over.items()) for c in quantiles([(x["p"]["key"], x["p"]["id"]) for x in dense if x["range"] == r], -(-2 * n * size // total))])
        if not set(finer) - set(bounds):
            break
        bounds = sorted(set(bounds) | set(finer))

    rows = ranged(bounds)
    order = W.partitionBy("range").orderBy("key", "id").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy("range", "key")
    local = rows.select("*", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"), F.row_number().over(W.partitionBy("range").orderBy("key", "id")).alias("rn"), F.sum("size").over(group).alias("gbytes"))
    local = local.withColumn("gstart", F.min("before").over(group))
    starts, byte, row = [], 0, 0
    for r in sorted(rows.groupBy("range").agg(F.sum("size"), F.count("*")).collect()):
        starts.append({"r": r[0], "byte": byte, "row": row})
        byte, row = byte + r[1], row + r[2]
    known = spark.sql("SELECT inline(from_json(:s, 'array<struct<r:int,byte:bigint,row:bigint>>'))", args={"s": json.dumps(starts)})
    middle = F.when(F.col("gbytes") <= WHOLE * total / shards, F.col("gstart") + F.col("gbytes") / 2).otherwise(F.col("before") + F.col("size") / 2)
    placed = (
        local.join(F.broadcast(known), local["range"] == known["r"])
        .select("id", "size", "crc", F.least(F.lit(shards - 1), F.floor((F.col("byte") + middle) * shards / max(1, total))).cast("int").alias("shard"), (F.col("row") + F.col("rn") - 1).alias("place"))
    )
    placed = materialise(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
