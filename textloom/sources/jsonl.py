"""JSON lines: validation, tolerant reading, append and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a generation record.
RECORD = "text_id string, text string, label int, generator string, domain string, source_id string, prompt_id string, generation_mode string, input_tokens long, output_tokens long"
FIELDS = [f.split()[0] for f in RECORD.split(", ")]


def is_json(c: Column) -> Column:
    return F.json_object_keys(c).isNotNull()


def missing(c: Column, fields: list[str]) -> Column:
    """Required keys that an object lacks (an explicit null is there); null for what is no object."""
    return F.array_except(F.array(*map(F.lit, fields)), F.json_object_keys(c))


def line_order() -> Column:
    """Order of a file source's rows: files by path, then their splits, then lines (rows of a split have growing ids, whatever other splits its task reads)."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))


def read_lines(spark: SparkSession, path: str, exclude: str | None = r"^(merged_|human_)") -> DataFrame:
    """Non-blank lines of *.jsonl files with file and position; files whose name matches `exclude` are left out."""
    lines = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"), line_order().alias("pos"))
    lines = lines.filter(F.trim("value") != "")
    return (lines.filter(~F.col("file").rlike(exclude)) if exclude else lines).drop("_path")


def validate(lines: DataFrame, schema: str = RECORD, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid records, invalid lines): bad JSON and records that lack a field are invalid."""
    gaps = missing(F.col("value"), fields or FIELDS)
    ok = F.coalesce(F.size(gaps) == 0, F.lit(False)) & gaps.isNotNull()
    valid = lines.filter(ok).select(F.from_json("value", schema).alias("r"), "file", "pos").select("r.*", "file", "pos")
    return valid, lines.filter(~ok)


def completed_keys(lines: DataFrame, keys: tuple[str, ...] = ("source_id", "generation_mode", "prompt_id"), schema: str = RECORD) -> DataFrame:
    """Keys that are done; truncated lines don't count."""
    return lines.select(F.from_json("value", schema).alias("r")).select(*[f"r.{k}" for k in keys]).filter(F.col(keys[0]).isNotNull()).distinct()


def merge_fields(lines: DataFrame, id_field: str, fields: list[str]) -> DataFrame:
    """Per id, later lines overwrite the fields they carry; null is a value like any other."""
    kind = f"{id_field} string, " + ", ".join(f"{f} string" for f in fields)
    rows = lines.select(F.from_json("value", kind).alias("r"), F.json_object_keys("value").alias("k"), "pos").filter(F.col(f"r.{id_field}").isNotNull())
    last = [F.max(F.when(F.array_contains("k", f), F.struct("pos", F.col(f"r.{f}").alias("v")))).getField("v").alias(f) for f in fields]
    return rows.groupBy(F.col(f"r.{id_field}").alias(id_field)).agg(*last)


def write_by_domain(records: DataFrame, path: str) -> None:
    """One folder of JSON lines per domain; Unicode stays as it is, nulls are written."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("domain").json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds JSON lines to a folder; nulls are written, so that a later null overwrites (see merge_fields)."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
