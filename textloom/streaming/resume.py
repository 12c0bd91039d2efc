"""Resumable, append-only outputs: each micro-batch adds only rows whose key isn't there yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.ranking import keep_last


def known(spark, path: str, schema) -> DataFrame:
    """What has been written so far; empty before the first batch."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Idempotent append: a batch that is run again adds nothing."""
    once = batch.dropDuplicates(keys)
    once.join(known(batch.sparkSession, path, batch.schema).select(*keys), keys, "left_anti").write.mode("append").parquet(path)


def run_resumable(stream: DataFrame, path: str, keys: list[str], checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Transforms each micro-batch and appends its new keys."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(step(batch), path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_best(runs: DataFrame, keys: list[str], score: str, columns: list[str]) -> DataFrame:
    """The best row so far of each key, of equal ones the first by `columns`; a stream gives it in update mode."""
    first = F.min_by(F.struct(*columns), F.struct((-F.col(score)).alias("s"), *columns))
    return runs.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.max(score).alias(score), first.alias("_best")).select(*keys, score, "_best.*")


def fill_cache(ids: DataFrame, path: str, checkpoint: str, client, batch: int = 50, workers: int = 8) -> StreamingQuery:
    """Dates of a stream of page ids (id), asked by `workers` tasks at a time for ids that the cache lacks, and appended to it."""
    from textloom.sources.connectors import with_dates

    schema = "id string, created string, last_modified string"

    def step(rows: DataFrame) -> DataFrame:
        open_ = rows.select("id").distinct().join(known(rows.sparkSession, path, schema).select("id"), "id", "left_anti")
        return with_dates(open_.repartition(workers), client, batch)

    def add(rows: DataFrame, _: int) -> None:
        step(rows).write.mode("append").parquet(path)

    return ids.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(rows: DataFrame, path: str, version: int) -> None:
    """Adds rows under a version; `present` shows the last version of each key. Writing one version again replaces it."""
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def present(spark, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key of a table that `upsert` writes."""
    return keep_last(spark.read.parquet(path), keys, [F.col("version")]).drop("version")


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The present state of an append-only progress log."""
    return keep_last(log, keys, [F.col(order)])
