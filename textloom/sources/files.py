"""Source tables in several formats, keyed by position where they have no key; report sinks."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators import allocation
from textloom.operators.ranking import keep_last, sorted_rank
from textloom.sources.json_array import read_json_array
from textloom.sources.jsonl import line_order

#: Column names of the domains' sources.
RENAMES = {"news": {"Headline": "title", "News Content": "human_text"}, "wikipedia": {"text": "human_text"}, "social_media": {"Message": "caption"}}


def positional_key(df: DataFrame, name: str = "source_id") -> DataFrame:
    """Row position in the whole source, as text: files by path, then lines; partitions in order where there are no files.

    Rows are counted for each split, and a split's rows numbered by their growing
    ids, so no task sees more than its own rows.
    """
    try:
        split = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        split = df.select("*", F.lit("").alias("_path"), F.spark_partition_id().cast("long").alias("_block"))
    rows = split.withColumn("_line", F.monotonically_increasing_id())
    sizes = rows.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_path", "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_path", "_block", "_first", before.alias("_before"))
    return rows.join(sizes, ["_path", "_block"]).withColumn(name, (F.col("_before") + F.col("_line") - F.col("_first")).cast("string")).select(*df.columns, name)


def read_source(spark: SparkSession, path: str, domain: str | None = None, format: str | None = None, schema: str | None = None) -> DataFrame:
    """JSON arrays, JSON lines, Parquet, ORC, CSV (quoted newlines too); Excel where openpyxl is installed.

    With a `schema`, a JSON array is one file of any size that many tasks read in
    chunks, and source_id, if the schema lacks it, is the element's byte position.
    """
    kind = format or os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if kind == "json" and schema:
        found = read_json_array(spark, [path]).select(F.from_json("value", schema).alias("e"), F.col("at").cast("string").alias("source_id"))
        return found.select("e.*", *([] if "source_id" in found.schema["e"].dataType.names else ["source_id"])).withColumnsRenamed(RENAMES.get(domain or "", {}))
    if kind == "json":
        df = spark.read.option("multiLine", True).json(path)
    elif kind == "jsonl":
        df = spark.read.json(path)
    elif kind in ("parquet", "orc"):
        df = spark.read.format(kind).load(path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    elif kind in ("xlsx", "xls"):
        try:
            import openpyxl  # noqa: F401
            import pandas as pd
        except ImportError as e:
            raise ValueError("Excel sources need openpyxl; convert the file to CSV or Parquet") from e
        df = spark.createDataFrame(pd.read_excel(path))
    else:
        raise ValueError(f"unknown source format: {path}")
    df = df.withColumn("source_id", F.col("source_id").cast("string")) if "source_id" in df.columns else positional_key(df)
    return df.withColumnsRenamed(RENAMES.get(domain or "", {}))


def needed_rows(source: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose key is wanted."""
    return source.join(ids.select("source_id").distinct(), "source_id", "left_semi")


def lookup(ids: DataFrame, source: DataFrame, text: str) -> DataFrame:
    """Every wanted id with its text and whether it was found, empty or missing; ordered by length, then value."""
    hit = source.select("source_id", F.col(text).alias("text"), F.lit(True).alias("_hit"))
    status = F.when(F.col("_hit").isNull(), "missing").when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").otherwise("found")
    return ids.select("source_id").distinct().join(hit, "source_id", "left").select("source_id", "text", status.alias("status")).orderBy(F.length("source_id"), "source_id")


def read_runs(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """A run log in CSV: the last row of each run_id; the budget column as a map."""
    log = spark.read.csv(path, header=True, inferSchema=True, escape='"').withColumn("pos", line_order())
    log = keep_last(log, ["run_id"], [F.col("pos")])
    if "budget" in log.columns:
        log = log.withColumn("budget", F.from_json(F.col("budget").cast("string"), "map<string,int>"))
    return log.filter(F.col("phase") == phase) if phase else log


#: The names of published splits and their order.
SPLITS = {"train": "train", "validation": "dev", "test": "test"}


def read_splits(parts: dict[str, DataFrame], check: bool = True, **sizes) -> DataFrame:
    """Published splits as one table with `split` and `pos`, the row's place by split, label and domain, else as it was.

    With `check` the integrity of pairs and splits is required (see require); `sizes` go there.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(SPLITS.values()) for x in (name, k)]), F.col("split"))
    whole = None
    for name, renamed in SPLITS.items():
        part = positional_key(parts[name], "_line").withColumn("split", F.lit(renamed))
        whole = part if whole is None else whole.unionByName(part)
    if check:
        require(whole, **sizes)
    ordered = sorted_rank(whole.withColumn("_rank", rank).withColumn("_at", F.col("_line").cast("long")), ["_rank", "label", "domain", "_at"], "pos")
    return ordered.drop("_rank", "_at", "_line")


def require(corpus: DataFrame, expected: int | None = None, sizes: dict[str, int] | None = None, unpunctuated: str | None = None) -> DataFrame:
    """The corpus, if its pairs and splits are sound; else a ValueError that names each broken check."""
    broken = allocation.violations(corpus, expected=expected, sizes=sizes, unpunctuated=unpunctuated).filter("broken > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['check']}: {r['broken']}" for r in broken))
    return corpus


def read_corpus(spark: SparkSession, path: str, expected: int | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """A built corpus, checked; FileNotFoundError where there is none."""
    try:
        corpus = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path}: build the corpus first") from e
    return require(corpus, expected, sizes)


def append_csv(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files, each with one header; read_runs takes it as one log."""
    rows.write.mode("append").option("escape", '"').csv(path, header=True)


def write_rejected(rows: DataFrame, path: str) -> None:
    """Rejected rows as CSV files that spreadsheets take for UTF-8: a byte order mark stands before each header."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Appends predictions (run_id, text_id, pred, ...), one folder for each run; a run that is written again replaces its own."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_report(df: DataFrame, path: str, formats: tuple[str, ...] = ("csv",)) -> None:
    """A small result table as one CSV, and as Markdown or LaTeX text beside it."""
    if "csv" in formats:
        df.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    text = {"md": markdown, "tex": latex}
    for kind in formats:
        if kind in text:
            df.sparkSession.createDataFrame([(text[kind](df),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{kind}")


def markdown(df: DataFrame) -> str:
    rows = [tuple("" if v is None else str(v) for v in r) for r in df.collect()]
    return "\n".join(f"| {' | '.join(r)} |" for r in [tuple(df.columns), tuple("---" for _ in df.columns), *rows])


def latex(df: DataFrame, best: str | None = None) -> str:
    rows = df.collect()
    top = max((r[best] for r in rows if r[best] is not None), default=None) if best else None
    cell = lambda c, v: rf"\textbf{{{v}}}" if c == best and v == top else str("" if v is None else v)
    body = [" & ".join(cell(c, r[c]) for c in df.columns) + r" \\" for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", " & ".join(df.columns) + r" \\ \hline", *body, r"\end{tabular}"])


def output_name(kind: str, domain: str, model: str = "") -> str:
    return {"generation": f"{domain}_{model}.jsonl", "merged": f"merged_{domain}.jsonl", "human": f"human_{domain}.jsonl"}[kind]


def prediction_name(run_id: str) -> str:
    return run_id.replace("|", "_").replace("/", "-") + ".npy"
