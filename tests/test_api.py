"""The generation flow end to end with fakes, and golden values recomputed from a small run log."""

import pytest
from pyspark.sql import functions as F

from textloom import api
from textloom.sources import connectors, jsonl
from textloom.streaming import resume

CONFIG = {
    "seed": 42,
    "models": {"m1": "vendor/m1", "m2": "vendor/m2"},
    "domains": {"news": {"samples_per_model": 10, "min_words": 3, "modes": {"mode_a": {"count": 4, "num_variants": 2}, "mode_b": {"count": 6, "num_variants": 2}}}},
    "prompts": {"news": {"mode_a": ["A {title} {min_word_count}", "B {title}"], "mode_b": ["C {human_text}", "D {human_text}"]}},
}


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([(str(k), f"t{k}", f"පෙළ වචන තුන {k}") for k in range(30)] + [("99", "short", "එක")], "source_id string, title string, human_text string")


def test_flow(spark, source, tmp_path):
    items = api.cached_allocation(spark, f"{tmp_path}/alloc", lambda: api.allocate(source, CONFIG, "news"))
    assert items.count() == 20 and items.select("source_id").distinct().count() == 20
    out = f"{tmp_path}/gen"
    assert api.generate(items, CONFIG, "news", "m1", connectors.FakeModel(), out, dry_run=True).count() == 10
    api.generate(items, CONFIG, "news", "m1", connectors.FakeModel(), out, fraction=0.5)
    first = spark.read.parquet(out).count()
    assert first == 6  # ceil(2 * .5) of two cells and ceil(3 * .5) of two
    for _ in range(2):
        api.generate(items, CONFIG, "news", "m1", connectors.FakeModel(), out)
    records = spark.read.parquet(out)
    assert records.count() == records.select("text_id").distinct().count() == 10
    human, lost = api.human_half(records, source.filter("source_id <> '5'"), "news")
    assert human.count() + lost.count() == 10
    corpus = api.build_corpus(records, human)
    assert corpus.groupBy("group").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    target = spark.createDataFrame([("news", "m1", 10), ("news", "m2", 10)], "domain string, model string, target_count int")
    status = {r["model"]: (r["status"], r["total_cost"] > 0) for r in api.progress(records, target, {"m1": (1e-6, 1e-6)}).collect()}
    assert status == {"m1": ("done", True), "m2": ("not_started", False)}
    records.write.json(f"{tmp_path}/lines")
    merged = api.merge(jsonl.read_lines(spark, f"{tmp_path}/lines/*.json", None))
    assert merged["records"].count() == 10 and merged["invalid"].count() == 0 and merged["duplicates"].count() == 0
    assert api.pilot(source, CONFIG, "news").count() == 2 * 2 * 4


def test_config_checks():
    assert api.check_config(CONFIG) == []
    bad = {**CONFIG, "models": {"m1": "TODO"}, "domains": {"news": {**CONFIG["domains"]["news"], "samples_per_model": 9}}}
    assert len(api.check_config(bad)) == 2


def test_dates_and_search(spark, source):
    dated = api.with_revision_dates(source, connectors.FakeHistory()).collect()
    assert {r["source_id"] for r in dated if r["created_date"] is None} == {"0", "7", "14", "21", "28"}
    cached = spark.createDataFrame([("0", "2001-01-01T00:00:00Z", "bad")], "id string, created string, last_modified string")
    again = {r["source_id"]: r for r in api.with_revision_dates(source, connectors.FakeHistory(), cached).collect()}
    assert again["0"]["created_date"].year == 2001 and again["0"]["last_modified_date"] is None
    assert api.search(source.withColumn("url", F.lit(None).cast("string")), "T1.$").count() == 10


def test_analysis(spark):
    corpus = spark.createDataFrame([(f"x{k}", f"g{k // 2}", "d", k % 2) for k in range(40)], "text_id string, group string, domain string, label int")
    preds = spark.createDataFrame([("m", s, f"x{k}", (k % 2) if k % (3 + s) else 1 - k % 2) for k in range(40) for s in (1, 2)], "model string, seed int, text_id string, pred int")
    got = api.analyse(preds, corpus, 200)
    ci = got["intervals"].first()
    assert ci["lo"] < got["summary"].first()["mean"] < ci["hi"]
    runs = spark.createDataFrame([("a", 1e-5, 0.5, 0), ("a", 2e-5, 0.7, 1), ("a", 3e-5, 0.7, 2)], "Model string, lr double, dev_macro_f1 double, pos int")
    assert api.best_lr(runs).first()["lr"] == 2e-5
    vectors = spark.createDataFrame([("d", "g", [1.0, 0.0], [1.0, 0.0]), ("d", "h", [1.0, 0.0], [0.0, 1.0])], "domain string, generator string, a array<double>, b array<double>")
    assert {(r["domain"], r["generator"]): r["cosine_mean"] for r in api.similarity(vectors).collect()}[None, None] == 0.5


def test_baselines_and_recorded_progress(spark, tmp_path):
    rows = [(f"x{k}", f"{'හොඳ ලස්සන' if k % 2 else 'නරක කැත'} පෙළ{k % 5} වචන{k % 3}", "ab"[k // 2 % 2], k % 2, ("train", "train", "dev", "test")[k // 4 % 4]) for k in range(64)]
    corpus = spark.createDataFrame(rows, "text_id string, text string, domain string, label int, split string")
    got = api.baselines(corpus, grid=(1.0,))
    scores = {(r["text"], r["features"]): r["test_macro_f1"] for r in got["summary"].collect()}
    assert scores == {(t, f): 1.0 for t in ("raw", "normalized") for f in ("word_1_2", "char_2_5")}
    assert got["by_domain"].count() == 8
    records = spark.createDataFrame([("news", "m", 10, 2)], "domain string, generator string, input_tokens long, output_tokens long")
    target = spark.createDataFrame([("news", "m", 1)], "domain string, model string, target_count int")
    for version in (1, 2):
        api.record_progress(records, target, {"m": (1.0, 1.0)}, f"{tmp_path}/p", version)
    (row,) = resume.present(spark, f"{tmp_path}/p", ["domain", "model"]).collect()
    assert row["status"] == "done" and row["total_cost"] == 12.0
