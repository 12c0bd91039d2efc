"""Features kept by the content of texts: only texts that the cache lacks are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut
from textloom.sources.commits import VersionedTable

DIGEST, CODE = "_digest", "_code"


def cached_features(df: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], code: str, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the columns that compute() gives, one row per row of df.

    compute() takes a frame with DIGEST (sha-256 of the text, null as empty) and the
    text and returns DIGEST and features; it has to treat each text by itself. The
    cache is keyed by digest and `code`, the version of the code that computes, so
    nothing stale is returned: a changed text or new code is computed, an unchanged
    text is not, wherever its row went. New rows are committed to the versioned
    table at `path`; two runs at once may compute a text twice, and one row counts.
    """
    table = VersionedTable(df.sparkSession, path)
    texts = df.select(*keys, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(DIGEST), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def known() -> DataFrame | None:
        rows = table.present([CODE, DIGEST])
        return None if rows is None else rows.filter(F.col(CODE) == code).drop(CODE)

    have = known()
    lacking = texts.select(DIGEST, "_text") if have is None else texts.select(DIGEST, "_text").join(have.select(DIGEST), DIGEST, "left_anti")
    lacking = lacking.dropDuplicates([DIGEST]).withColumnRenamed("_text", text)
    new = cut(compute(lacking).withColumn(CODE, F.lit(code)))
    if have is None or not new.isEmpty():
        table.append(new)
    return texts.drop("_text").join(known(), DIGEST).drop(DIGEST)


def stale(df: DataFrame, path: str, code: str, text: str = "text") -> DataFrame:
    """Digests that the cache has for this code and df no longer holds."""
    rows = VersionedTable(df.sparkSession, path).present([CODE, DIGEST])
    if rows is None:
        return df.sparkSession.createDataFrame([], f"{DIGEST} string")
    now = df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(DIGEST))
    return rows.filter(F.col(CODE) == code).select(DIGEST).join(now, DIGEST, "left_anti")
