"""Every catalogued query against its DuckDB oracle."""

import glob
import math
import os

import duckdb
import pytest

from textloom import catalog

SLOW = {"tfidf_lr", "stylometric_lr", "pair_bootstrap_ci"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is None, x or "") for x in r)
    theirs = [tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()]
    ours = [tuple(plain(r[c]) for c in cols) for r in got.collect()]
    assert sorted(ours, key=key) == sorted(theirs, key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_models(spark, sf_dir):
    """The fits themselves are tested in test_functions; here, that the queries run on the tables."""
    r = catalog.QUERIES["stylometric_lr"](spark, sf_dir).first()
    assert 0 <= r["accuracy"] <= 1 and 0 <= r["macro_f1"] <= 1
    rows = {r["features"]: r for r in catalog.QUERIES["tfidf_lr"](spark, sf_dir).collect()}
    assert set(rows) == {"word_1_2", "char_2_5"} and all(r["n_terms"] > 100 and 0 <= r["test_macro_f1"] <= 1 for r in rows.values())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_strip_categories_keeps_tagged_pages(spark, tmp_path):
    pages = [
        (1, "Text.\n\nCategory:Rivers\nCategory : Lakes", True, "Text."),
        (2, "It flows.Category:Rivers\n\n\n\nMore.", True, "It flows.\n\nMore."),
        (3, "[[Category:A]]\nOne\n\nCategory:B\n\nTwo", True, "One\n\nTwo"),
        (4, "An award in the Category: best film", True, "An award in the Category: best film"),
        (5, " no tag ", False, " no tag "),
        (6, None, None, None),
    ]
    spark.createDataFrame([p[:2] for p in pages], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["strip_categories"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["tagged"], r["text"]) for r in got) == [(k, tagged, text) for k, _, tagged, text in pages]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.sql(f"SELECT page_id, tagged, text FROM ({catalog.ORACLE_SQL['strip_categories']})").fetchall()) == [(k, tagged, text) for k, _, tagged, text in pages]


def test_bootstrap_interval(spark, sf_dir):
    """Around the macro-F1 of the whole table, and narrow."""
    r = catalog.QUERIES["pair_bootstrap_ci"](spark, sf_dir).first()
    whole = sum(x["full_f1"] for x in catalog.QUERIES["size_control"](spark, sf_dir).collect())
    assert r["lo"] < whole < r["hi"] and r["hi"] - r["lo"] < 0.4


def test_effect_sizes_of_null_texts(spark, tmp_path):
    """n_1 and n_0 count null texts, as the SQL does."""
    docs = [(k, None if k % 10 == 9 else "a b " * (k % 7 + 1), "en", 0) for k in range(196)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").repartition(2, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(196)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = catalog.QUERIES["cohens_d_grid"](spark, str(tmp_path)).collect()
    want = con.sql(f"SELECT lang, feature, n_1, n_0, cohens_d FROM ({catalog.ORACLE_SQL['cohens_d_grid']})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in want) == sorted(tuple(plain(r[c]) for c in ("lang", "feature", "n_1", "n_0", "cohens_d")) for r in got)


def test_effect_size_of_constant_in_parts(spark):
    """Parts of 49 rows, whose merged mean of ones is not 1 in its last bits."""
    from textloom.operators import stats

    ones = spark.range(0, 98, 1, 2).selectExpr("1 AS label", "1.0D AS one").unionByName(spark.range(0, 98, 1, 2).selectExpr("0 AS label", "1.0D AS one"))
    r = stats.cohens_d(ones, [], ["one"]).first()
    assert (r["n_1"], r["n_0"], r["cohens_d"]) == (98, 98, None)
