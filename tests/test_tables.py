"""Versioned tables, the feature cache, and features that need Python."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from textloom.functions import features as fx
from textloom.functions import udf
from textloom.operators import feature_cache
from textloom.sources.commits import Conflict, VersionedTable


def test_two_writers_lose_no_row(spark, tmp_path):
    """Threads append and upsert at once; every commit is in the end, in its place."""
    path, errors = str(tmp_path / "t"), []

    def write(who):
        try:
            table = VersionedTable(spark, path)
            for k in range(5):
                table.append(spark.createDataFrame([(who, k, 10 * who + k)], "who int, k int, v int"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = VersionedTable(spark, path)
    assert not errors and table.latest() == 20 and len(table.parts(20)) == 20
    assert sorted((r["who"], r["k"]) for r in table.read().collect()) == [(w, k) for w in range(4) for k in range(5)]
    of_first = [r["k"] for r in table.read().filter("who = 0").orderBy("_seq").collect()]
    assert of_first == [0, 1, 2, 3, 4]
    assert {r["who"]: r["k"] for r in table.present(["who"]).collect()} == {w: 4 for w in range(4)}


def test_conflict_makes_a_compaction_start_again(spark, tmp_path, monkeypatch):
    table, other = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t"))
    row = lambda k, v: spark.createDataFrame([(k, v)], "k int, v int")
    assert table.read() is None and table.present(["k"]) is None and table.compact(["k"]) == 1
    table.append(row(1, 1))
    table.upsert(row(1, 2))
    before = table.present
    calls = []

    def late(keys, version=None):
        calls.append(version)
        if len(calls) == 1:
            other.append(row(2, 5))  # commits between this snapshot and the compaction's manifest
        return before(keys, version)

    monkeypatch.setattr(table, "present", late)
    assert table.compact(["k"]) == 5 and calls == [3, 4]
    monkeypatch.undo()
    assert sorted(map(tuple, table.present(["k"]).collect())) == [(1, 2), (2, 5)] and len(table.parts(5)) == 1
    assert sorted(map(tuple, other.present(["k"], 2).collect())) == [(1, 1)]  # older snapshots stay
    assert table.vacuum() == 4 and table.read().count() == 2
    monkeypatch.setattr(other, "_create", lambda *a: False)
    with pytest.raises(Conflict):
        VersionedTable.commit(other, lambda seen: [])


def test_new_columns_and_part_names(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/a b")
    table.append(spark.createDataFrame([(1, "x")], "k int, s string"))
    table.append(spark.createDataFrame([(2, None, 3.5)], "k int, s string, d double"))
    assert sorted((r["k"], r["d"], r["_seq"]) for r in table.read().collect()) == [(1, None, 0), (2, 3.5, 1)]


def test_feature_cache(spark, tmp_path):
    """Changed, added, removed, repeated and null texts; only texts that are new are computed."""
    path, seen = str(tmp_path / "cache"), []

    def compute(rows):
        seen.append(sorted(r["text"] for r in rows.select("text").collect()))
        return rows.select(feature_cache.DIGEST, F.length("text").alias("chars"))

    def run(rows, code="1"):
        df = spark.createDataFrame(rows, "text_id int, text string")
        return sorted(map(tuple, feature_cache.cached_features(df, path, compute, code, ["text_id"]).select("text_id", "chars").collect()))

    assert run([(1, "one"), (2, "three"), (3, "one"), (4, None)]) == [(1, 3), (2, 5), (3, 3), (4, 0)]
    assert run([(1, "one"), (2, "changed"), (5, "added"), (6, "three"), (7, "")]) == [(1, 3), (2, 7), (5, 5), (6, 5), (7, 0)]
    assert run([(1, "one")]) == [(1, 3)]
    assert run([(1, "one")], code="2") == [(1, 3)]
    assert run([]) == []
    assert seen == [["", "one", "three"], ["added", "changed"], [], ["one"], []]
    now = spark.createDataFrame([(1, "one"), (2, "changed")], "text_id int, text string")
    assert feature_cache.stale(now, path, "1").count() == 3 and feature_cache.stale(now, path, "3").count() == 0


def plain_mattr(w, n=50):
    if len(w) <= n:
        return len(set(w)) / len(w) if w else 0.0
    many = [len(set(w[k : k + n])) / n for k in range(len(w) - n + 1)]
    return sum(many) / len(many)


def test_mattr_and_fertility(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [None, "", " \n", "a", "A a", "naïve word x", *(" ".join(rng.choice("abcdefgh") + str(rng.randrange(m)) for _ in range(n)) for n, m in ((49, 3), (50, 3), (51, 3), (120, 1), (700, 9), (5000, 100)))]
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    got = {r["i"]: r for r in df.select("i", fx.mattr(F.col("text")).alias("m"), fx.fertility(F.col("text"), spec).alias("f")).collect()}
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        w = (t or "").split()
        assert abs(got[i]["m"] - plain_mattr(w)) < 1e-12
        assert got[i]["f"] == (len(tokenizer.encode(t, add_special_tokens=False).ids) / len(w) if w else 0.0)
    table = fx.feature_table(df, keys=["i"], fertility=fx.fertility(F.col("text"), spec))
    assert {r["i"]: r["fertility"] for r in table.collect()} == {i: r["f"] for i, r in got.items()}
    assert fx.feature_table(df, keys=["i"]).agg(F.max("fertility")).first()[0] == 0.0
    assert udf.rolling_ttr(["a"] * 60, 50) == 1 / 50


def test_run_grid_goes_on(spark, tmp_path):
    """A grid that breaks off; settings in another order; a second phase; the best of it."""
    from textloom.operators import runs

    log, made = VersionedTable(spark, str(tmp_path / "runs")), []

    def fit(s):
        made.append(s["lr"])
        if s["lr"] == 3 and made.count(3) == 1:
            raise RuntimeError("lost")
        return {"f1": 1.0 - abs(s["lr"] - 2) / 10}

    grid = [{"model": "m", "lr": k} for k in (1, 2, 3, 1)]
    with pytest.raises(RuntimeError):
        runs.run_grid(grid, log, "search", fit)
    assert [s["lr"] for s in runs.pending(grid, log, "search")] == [3]
    again = [{"lr": k, "model": "m"} for k in (3, 2, 1)]
    found = runs.run_grid(again, log, "search", fit)
    assert found.count() == 3 and made == [1, 2, 3, 3]
    best = runs.best_settings(found, "f1")
    assert best == {"lr": 2, "model": "m"}
    assert runs.run_grid([best | {"seed": 1}], log, "main", fit).count() == 1 and made[-1] == 2 and log.present(["run_id"]).count() == 4
    assert runs.run_grid([], log, "main", fit).count() == 0
    with pytest.raises(ValueError, match="no runs"):
        runs.best_settings(found.limit(0), "f1")


def test_two_drivers_record_progress(spark, tmp_path):
    from textloom import api

    path = str(tmp_path / "progress")
    records = spark.createDataFrame([("news", "a", 10, 5), ("news", "a", 10, 5), ("news", "b", 1, 1)], "domain string, generator string, input_tokens long, output_tokens long")
    target = spark.createDataFrame([("news", "a", 2), ("news", "b", 3)], "domain string, model string, target_count long")
    threads = [threading.Thread(target=api.record_progress, args=(records.filter(F.col("generator") == g), target.filter(F.col("model") == g), {"a": (0.1, 0.2)}, path)) for g in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r["model"]: (r["completed_count"], r["status"]) for r in VersionedTable(spark, path).present(["domain", "model"]).collect()}
    assert got == {"a": (2, "done"), "b": (1, "in_progress")}
