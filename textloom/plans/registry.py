"""Where plans put their queries and DuckDB oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            rounded = sorted(set(re.findall(r"AS DECIMAL\(18,\d\)\) AS (\w+)", sql)))
            fixed = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in rounded)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({fixed}) FROM ({sql})" if fixed else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(c, scale: int = 6):
    """Doubles through decimals, so that the last bits of a sum don't count; the oracles do the same."""
    from pyspark.sql import functions as F

    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})").cast("double")


#: Words of documents in SQL.
SQL_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
SQL_DOCS = f"(SELECT *, {SQL_WORDS} AS w FROM documents)"
