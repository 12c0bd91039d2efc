"""The pipeline against brute-force versions of its stages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from test_operators import contaminated, ids_of, near_expected

from textloom.llm import language
from textloom.llm.common import table


def test_stages_are_the_contract_s():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "decontamination", "packing"]


def test_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if found[r["doc_id"]]["lang_pred"] != "und"}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: t for t, i in last.items()}
    rows = {i: rows[i] for i, (_, _, kept) in near_expected(list(rows.items())).items() if kept}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = {i: rows[i] for i, r in contaminated(list(rows.items()), items).items() if not r[-1]}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    lengths = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(ids) + 1 for i, ids in zip(rows, ids_of(rows.values()), strict=True)}


def test_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, an id with two texts, other columns; an empty table."""
    long = " ".join(f"word{k}" for k in range(80))
    item = " ".join(f"bench{k}" for k in range(20))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "der und nicht schön", "de"), (2, long, "en"), (2, long, "en"), (3, long + " end", None), (None, "a text without an id", None), (None, "a text without an id", None), (None, item, None), (5, None, None), (6, "", None), (7, "12 !", None), (8, item, "en"), (9, "first text of nine", "en"), (9, "second words for it", "en"), (10, "a text without an id", "en")]
    spark.createDataFrame([(*r, "s", 1) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"] or 0, r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    size = {t: len(ids) + 1 for t, ids in zip([r[1] for r in rows], ids_of([r[1] for r in rows]), strict=True)}
    want = [(1, rows[0][1]), (2, long), (9, rows[11][1]), (9, rows[12][1]), (10, "a text without an id")]
    assert got == sorted((i, size[t]) for i, t in want)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
