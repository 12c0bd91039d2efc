"""Session helper used by the tests, the bench and the command line."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", name: str = "textloom", **extra: str) -> SparkSession:
    """A session with the settings that the queries expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**CONF, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, its lineage cut: what is read several times is computed once.

    Where no such folder is set, a local master gets a temporary one; a cluster, whose machines would not share it, an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint()
