"""Entry points: generate, pilot, merge, human_half, with_revision_dates, search, analyse, similarity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import allocation, ml, pairs, quality, ranking, stats
from textloom.sources import connectors, files, jsonl
from textloom.sources.commits import VersionedTable
from textloom.streaming.resume import append_new, known, upsert

#: Which column holds a domain's human text.
TEXT_FIELD = {"news": "human_text", "wikipedia": "human_text", "social_media": "caption"}
PLACEHOLDER_MARK = "TODO"


def read_config(path: str) -> dict:
    """A YAML or JSON configuration: seed, models, domains, prompts."""
    import json

    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def check_config(config: dict) -> list[str]:
    """What is wrong: mode counts that don't sum up, unfinished templates and model ids, too few prompts."""
    found = [f"model {name} is unfinished" for name, full in config["models"].items() if PLACEHOLDER_MARK in str(full)]
    for domain, d in config["domains"].items():
        counts = sum(m["count"] for m in d["modes"].values())
        if counts != d["samples_per_model"]:
            found.append(f"{domain}: modes take {counts} of {d['samples_per_model']}")
        for mode, m in d["modes"].items():
            templates = config["prompts"].get(domain, {}).get(mode, [])
            if len(templates) < m["num_variants"]:
                found.append(f"{domain}/{mode}: too few prompts")
            found += [f"{domain}/{mode}: prompt {k} is unfinished" for k, t in enumerate(templates) if PLACEHOLDER_MARK in t]
    return found


def source_pool(source: DataFrame, domain: str, settings: dict, script: str = tx.SINHALA) -> DataFrame:
    """Usable items of a domain: content checks, dates before max_date, length, script."""
    field = TEXT_FIELD.get(domain)
    if field is None:
        return source
    if domain == "wikipedia":
        source, _ = quality.clean_and_rejected(source, field, title="title" if "title" in source.columns else None, min_words=settings.get("min_words", 100), script=script)
        if settings.get("max_date") and {"created_date", "last_modified_date"} <= set(source.columns):
            source, _ = quality.date_partition(source, ["created_date", "last_modified_date"], settings["max_date"])
    return quality.source_items(source, field, settings.get("min_words", 0), script)


def allocate(source: DataFrame, config: dict, domain: str, script: str = tx.SINHALA) -> DataFrame:
    """model, mode, variant, pos and the item: disjoint slices of one seeded permutation."""
    settings = config["domains"][domain]
    pool = source_pool(source, domain, settings, script)
    cut = allocation.model_slices(pool, "source_id", list(config["models"]), settings["samples_per_model"], config.get("seed", 42))
    placed = allocation.modes(cut, {m: (s["count"], s["num_variants"]) for m, s in settings["modes"].items()}, ["model"])
    if not allocation.overlaps(placed, "source_id", ["model", "mode", "variant"]).isEmpty():
        raise ValueError("a source item lies in two cells")
    keep = [c for c in ("source_id", "title", "human_text", "caption") if c in placed.columns]
    return placed.select("model", "mode", "variant", "pos", *keep)


def cached_allocation(spark: SparkSession, path: str, make) -> DataFrame:
    """The allocation at `path`, made on first use."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def prompts(items: DataFrame, config: dict, domain: str) -> DataFrame:
    """id, model, mode, variant, prompt_id, prompt of each item."""
    field = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    low, high = tx.target_band(field("human_text"), field("caption"))
    values = {"title": field("title"), "human_text": field("human_text"), "caption": field("caption"), "human_prefix": F.lit(""), "min_word_count": low, "max_word_count": high}
    prompt = F.when(F.lit(False), "")
    for mode, templates in config["prompts"][domain].items():
        for k, t in enumerate(templates):
            prompt = prompt.when((F.col("mode") == mode) & (F.col("variant") == k), tx.fill(t, values))
    key = F.concat_ws("", F.lit(f"{domain}_"), "mode", F.lit("_v"), F.col("variant").cast("string"))
    return items.select("source_id", "model", "mode", "variant", key.alias("prompt_id"), prompt.alias("prompt"))


def generate(items: DataFrame, config: dict, domain: str, model: str, client: connectors.TextModel, path: str, fraction: float = 1.0, dry_run: bool = False) -> DataFrame:
    """Generates what isn't in `path` yet and appends it; dry_run gives the open prompts. Failed calls are kept aside with their costs."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be over 0 and at most 1")
    if wrong := check_config(config):
        raise ValueError("; ".join(wrong))
    spark = items.sparkSession
    mine = allocation.fraction_prefix(items.filter(F.col("model") == model).withColumnRenamed("pos", "at"), ["mode", "variant"], ["at"], fraction)
    wanted = prompts(mine, config, domain)
    done = known(spark, path, jsonl_schema()).select("source_id", F.col("generation_mode").alias("mode"), "prompt_id")
    open_ = wanted.join(done, ["source_id", "mode", "prompt_id"], "left_anti")
    if dry_run:
        return open_
    asked = open_.withColumn("id", F.concat_ws("_", F.lit(domain), "model", "mode", "source_id")).repartition(max(1, spark.sparkContext.defaultParallelism))
    replies = connectors.generate(asked.withColumn("model", F.lit(config["models"][model])), client)
    kept = f"{path}_replies/{uuid.uuid4().hex}"  # written before use: a lost executor never makes a paid call run again
    asked.drop("model").join(replies, "id").write.parquet(kept)
    both = spark.read.parquet(kept)
    good = both.filter("error IS NULL").select(
        F.col("id").alias("text_id"), "text", F.lit(1).alias("label"), F.lit(model).alias("generator"), F.lit(domain).alias("domain"), "source_id", "prompt_id", F.col("mode").alias("generation_mode"), "input_tokens", "output_tokens"
    )
    append_new(good, path, ["source_id", "generation_mode", "prompt_id"])
    both.filter("error IS NOT NULL").select("id", "error", "billed_input", "billed_output").write.mode("append").parquet(f"{path}_failed")
    return both.select("id", "error")


def jsonl_schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(jsonl.RECORD)


def pilot(source: DataFrame, config: dict, domain: str, n: int = 2, seed: int = 42) -> DataFrame:
    """Prompts of n sampled items for every model, mode and variant; unfinished templates are skipped."""
    settings = config["domains"][domain]
    sample = ranking.shuffle_rank(source, "source_id", seed).filter(F.col("rn") <= n).drop("rn")
    grid = [(m, mode, k) for m in config["models"] for mode, s in settings["modes"].items() for k in range(s["num_variants"]) if PLACEHOLDER_MARK not in config["prompts"][domain][mode][k]]
    cells = source.sparkSession.createDataFrame(grid, "model string, mode string, variant int")
    return prompts(sample.join(F.broadcast(cells), F.lit(True)), config, domain)


def progress(records: DataFrame, target: DataFrame, prices: dict[str, tuple[float, float]], failed: DataFrame | None = None) -> DataFrame:
    """Per domain and model: done, wanted, cost (unknown models cost 0; billed failures count) and status."""
    rows = [(m, a, b) for m, (a, b) in prices.items()] or [("", 0.0, 0.0)]
    price = records.sparkSession.createDataFrame(rows, "generator string, p_in double, p_out double")
    costed = records.join(F.broadcast(price), "generator", "left").withColumn("cost", F.coalesce(F.col("input_tokens") * F.col("p_in") + F.col("output_tokens") * F.col("p_out"), F.lit(0.0)))
    done = costed.groupBy("domain", F.col("generator").alias("model")).agg(F.count("*").alias("completed_count"), F.sum("cost").alias("total_cost"))
    if failed is not None:
        lost = failed.join(F.broadcast(price), F.col("model") == F.col("generator"), "left").groupBy("domain", "model").agg(F.sum(F.coalesce(F.col("billed_input") * F.col("p_in") + F.col("billed_output") * F.col("p_out"), F.lit(0.0))).alias("lost"))
        done = done.join(lost, ["domain", "model"], "left").withColumn("total_cost", F.col("total_cost") + F.coalesce("lost", F.lit(0.0))).drop("lost")
    out = target.join(done, ["domain", "model"], "left").na.fill(0, ["completed_count"]).na.fill(0.0, ["total_cost"])
    return out.withColumn("status", F.when(F.col("completed_count") >= F.col("target_count"), "done").when(F.col("completed_count") > 0, "in_progress").otherwise("not_started"))


def record_progress(records: DataFrame, target: DataFrame, prices: dict[str, tuple[float, float]], path: str, version: int | None = None, failed: DataFrame | None = None) -> None:
    """Writes the progress table; several drivers may do so at once.

    VersionedTable(spark, path).present(["domain", "model"]) shows the last row of
    each. With a `version`, which then only one driver may write, it is stored under
    that, and resume.present() shows it.
    """
    rows = progress(records, target, prices, failed)
    if version is None:
        VersionedTable(records.sparkSession, path).upsert(rows)
    else:
        upsert(rows, path, version)


def merge(lines: DataFrame) -> dict[str, DataFrame]:
    """Valid records, invalid lines, counts by mode and generator, and texts that stand under several ids."""
    valid, invalid = jsonl.validate(lines)
    counts = valid.groupBy("domain", "generation_mode", "generator").agg(F.count("*").alias("n"))
    copies = valid.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count_distinct("text_id").alias("ids"), F.min(tx.preview(F.col("text"))).alias("preview"), F.min("text_id").alias("first_id")).filter("ids > 1")
    return {"records": valid, "invalid": invalid, "counts": counts, "duplicates": copies}


def human_half(records: DataFrame, source: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """(human records of the sources that were used, ids whose text is missing or empty)."""
    found = files.lookup(records.filter(F.col("domain") == domain).select("source_id"), source, TEXT_FIELD[domain])
    none = lambda kind: F.lit(None).cast(kind)
    human = found.filter("status = 'found'").select(
        F.concat(F.lit(f"{domain}_human_"), "source_id").alias("text_id"), "text", F.lit(0).alias("label"), F.lit("human").alias("generator"), F.lit(domain).alias("domain"), "source_id",
        none("string").alias("prompt_id"), F.lit("human").alias("generation_mode"), none("long").alias("input_tokens"), none("long").alias("output_tokens"),
    )
    return human, found.filter("status <> 'found'").select("source_id", "status")


def build_corpus(generated: DataFrame, human: DataFrame, seed: int = 42, normalise: bool = False) -> DataFrame:
    """The paired corpus: group, word count and a leak-free split."""
    both = generated.unionByName(human.select(*generated.columns))
    text = tx.normalise(F.col("text")) if normalise else F.col("text")
    both = both.withColumn("text", text).withColumn("group", F.concat_ws("_", "domain", "source_id")).withColumn("word_count", F.size(tx.words(F.col("text"))))
    return allocation.three_way(both, "group", seed=seed)


def with_revision_dates(pages: DataFrame, client: connectors.PageHistory, cached: DataFrame | None = None) -> DataFrame:
    """created_date and last_modified_date of each page (null: unknown), asking only for pages that aren't cached."""
    ids = pages.select(F.col("source_id").alias("id")).distinct()
    fresh = connectors.with_dates(ids if cached is None else ids.join(cached.select("id"), "id", "left_anti"), client)
    dates = fresh if cached is None else fresh.unionByName(cached.select("id", "created", "last_modified"))
    dates = dates.select(F.col("id").alias("source_id"), F.try_to_timestamp("created").alias("created_date"), F.try_to_timestamp("last_modified").alias("last_modified_date"))
    return pages.join(dates, "source_id", "left")


def search(pages: DataFrame, query: str, columns: tuple[str, ...] = ("title", "url")) -> DataFrame:
    """Rows in which a column matches the query, a regular expression, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).rlike(query.lower()), F.lit(False))
    return pages.filter(hit)


def analyse(predictions: DataFrame, corpus: DataFrame, n_boot: int = 1000) -> dict[str, DataFrame]:
    """Tables of a detection experiment from long predictions (model, seed, text_id, pred): scores, by domain, intervals."""
    rows = predictions.join(corpus.select("text_id", "group", "domain", "label"), "text_id")
    by_seed = stats.scores(stats.confusion(rows, ["model", "seed"]))
    summary = by_seed.groupBy("model").agg(F.bround(F.avg("macro_f1"), 4).alias("mean"), F.bround(F.stddev_samp("macro_f1"), 4).alias("sd"))
    by_domain = stats.scores(stats.confusion(rows, ["model", "domain", "seed"])).groupBy("model", "domain").agg(F.bround(F.avg("macro_f1"), 4).alias("mean"))
    ci = stats.percentile_ci(stats.paired_bootstrap(rows, "group", "model", "seed", n_boot), ["model"], "macro_f1")
    return {"runs": by_seed, "summary": summary, "by_domain": by_domain, "intervals": ci}


def best_lr(runs: DataFrame, metric: str = "dev_macro_f1") -> DataFrame:
    """The learning rate of each model's best search run; of equal ones the first."""
    return runs.groupBy("Model").agg(F.max_by("lr", F.struct(metric, -F.col("pos"))).alias("lr"), F.bround(F.max(metric), 4).alias(metric))


def baselines(corpus: DataFrame, grid: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> dict[str, DataFrame]:
    """TF-IDF baselines on raw and normalised texts of a split corpus (text_id, text, domain, label, split): summary and scores by domain."""
    spark, summary, domains = corpus.sparkSession, [], []
    for name, text in {"raw": F.col("text"), "normalized": tx.normalise(F.col("text"))}.items():
        rows = corpus.withColumn("text", text)
        for kind in ml.TERM_KINDS:
            whole, parts = ml.tfidf_experiment(rows, "text_id", kind=kind, grid=grid)
            summary.append((name, *whole.values()))
            domains += [(name, *p.values()) for p in parts]
    kinds = "text string, features string, n_terms long, c double, dev_macro_f1 double, test_macro_f1 double, test_accuracy double, test_roc_auc double"
    return {"summary": spark.createDataFrame(summary, kinds), "by_domain": spark.createDataFrame(domains, "text string, features string, domain string, test_macro_f1 double")}


def similarity(pairs_df: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ("domain", "generator")) -> DataFrame:
    """Cosines of embedding pairs, summarised at all groupings of `by`."""
    return pairs.summarise(pairs_df.select(*by, pairs.cosine(F.col(a), F.col(b)).alias("cosine")), list(by), ["cosine"], median=False)
