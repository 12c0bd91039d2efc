"""Seeded, disjoint allocation, splits and folds, by ranks of md5(seed:id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import has_punctuation
from textloom.operators.ranking import shuffle_rank


def model_slices(df: DataFrame, id_col: str, models: list[str], per_model: int, seed: int = 42) -> DataFrame:
    """One permutation, cut into a slice of per_model rows for each model in turn; fails if there are too few rows."""
    if df.count() < per_model * len(models):
        raise ValueError("fewer rows than the slices need")
    ranked = shuffle_rank(df, id_col, seed).filter(F.col("rn") <= per_model * len(models))
    return ranked.withColumn("model", F.element_at(F.array(*map(F.lit, models)), (F.floor((F.col("rn") - 1) / per_model) + 1).cast("int"))).withColumn("pos", (F.col("rn") - 1) % per_model + 1).drop("rn")


def modes(df: DataFrame, counts: dict[str, tuple[int, int]], keys: list[str], pos: str = "pos") -> DataFrame:
    """Contiguous slices of `pos` by mode, each dealt to its number of variants, the first ones taking the remainder."""
    mode: Column = F.when(F.lit(False), "")
    at = 0
    for name, (size, _) in counts.items():
        mode = mode.when((F.col(pos) > at) & (F.col(pos) <= at + size), name)
        at += size
    placed = df.withColumn("mode", mode).filter("mode IS NOT NULL")
    parts = [placed.filter(F.col("mode") == name).withColumn("variant", F.ntile(k).over(W.partitionBy(*keys).orderBy(pos)) - 1) for name, (_, k) in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlaps(df: DataFrame, id_col: str, cell: list[str]) -> DataFrame:
    """Ids in more than one cell."""
    return df.groupBy(id_col).agg(F.count_distinct(F.concat_ws("/", *cell)).alias("cells")).filter("cells > 1")


def fraction_prefix(df: DataFrame, cell: list[str], order: list[str], fraction: float) -> DataFrame:
    """The first ceil(n * fraction) rows of each cell."""
    w = W.partitionBy(*cell)
    ranked = df.withColumn("pos", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.filter(F.col("pos") <= F.ceil(F.col("_n") * fraction)).drop("_n")


def group_split(df: DataFrame, group: str, share: float, seed: int = 42, names: tuple[str, str] = ("train", "dev")) -> DataFrame:
    """Whole groups to the second side, ceil(share * groups) of them."""
    groups = df.select(group).distinct()
    n = groups.count()
    ranked = shuffle_rank(groups, group, seed).select(group, F.when(F.col("rn") <= F.ceil(F.lit(n * share)), names[1]).otherwise(names[0]).alias("split"))
    return df.join(ranked, group)


def three_way(df: DataFrame, group: str, train: float = 0.7, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """train, dev and test by whole groups."""
    groups = df.select(group).distinct()
    n = groups.count()
    side = F.when(F.col("rn") <= F.floor(F.lit(n * train)), "train").when(F.col("rn") <= F.floor(F.lit(n * (train + dev))), "dev").otherwise("test")
    return df.join(shuffle_rank(groups, group, seed).select(group, side.alias("split")), group)


def subsample(df: DataFrame, group: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of n groups."""
    chosen = shuffle_rank(df.select(group).distinct(), group, seed).filter(F.col("rn") <= n).select(group)
    return df.join(chosen, group, "left_semi")


def violations(df: DataFrame, group: str = "group", label: str = "label", split: str = "split", domain: str = "domain", pair: int = 2, expected: int | None = None, sizes: dict[str, int] | None = None, unpunctuated: str | None = None, text: str = "text") -> DataFrame:
    """Integrity checks of a split corpus; one row for each check, with how often it is broken.

    `unpunctuated` is a domain whose texts must hold no punctuation but the Latin placeholder.
    """
    by_group = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(split).alias("splits"))
    bad = [by_group.agg(F.count_if(F.col("n") != pair).alias("broken")).select(F.lit("pair_size").alias("check"), "broken"), by_group.agg(F.count_if(F.col("splits") > 1).alias("broken")).select(F.lit("group_leak").alias("check"), "broken")]
    balance = df.groupBy(split).agg((F.count_if(F.col(label) == 0) != F.count_if(F.col(label) == 1)).alias("off"))
    bad.append(balance.agg(F.count_if("off").alias("broken")).select(F.lit("label_balance").alias("check"), "broken"))
    cells = df.select(domain).distinct().join(F.broadcast(df.select(label).distinct()), F.lit(True))
    seen = df.select(domain, label).distinct()
    bad.append(cells.join(seen, [domain, label], "left_anti").agg(F.count("*").alias("broken")).select(F.lit("empty_cell").alias("check"), "broken"))
    if expected is not None:
        bad.append(df.agg((F.count("*") != expected).cast("long").alias("broken")).select(F.lit("row_count").alias("check"), "broken"))
    if unpunctuated is not None:
        marked = (F.col(domain) == unpunctuated) & has_punctuation(F.col(text))
        bad.append(df.agg(F.count_if(marked).alias("broken")).select(F.lit("punctuation").alias("check"), "broken"))
    for name, n in (sizes or {}).items():
        bad.append(df.agg((F.count_if(F.col(split) == name) != n).cast("long").alias("broken")).select(F.lit(f"size_{name}").alias("check"), "broken"))
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out
