"""Rows that share an id with other texts lose nothing: each is judged by its own text."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from test_operators import ids_of, near_expected, repeats, rnd_text

from textloom.llm import near_dedup, substring_dedup

KIND = "doc_id long, text string"


def near_by_row(rows):
    """(id, shingles, smallest id that links lead to, kept) of each row; links are between rows."""
    found = near_expected([(k, t) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, (_, top, _) in found.items():
        groups.setdefault(top, []).append(rows[k][0])
    return sorted((i, found[k][0], min(groups[found[k][1]]), i == min(groups[found[k][1]])) for k, (i, _) in enumerate(rows))


def random_rows(rng, n):
    """Few ids for many texts, some of them near copies of others."""
    base = [rnd_text(rng, 80, 10**6) for _ in range(n // 4)]
    rows = []
    for _ in range(n):
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((rng.randrange(n // 2), " ".join(words) if rng.random() < 0.8 else rnd_text(rng, 60, 10**6)))
    return rows


def test_near_dedup_keeps_the_other_text(spark):
    rng = random.Random(2)
    a, b = rnd_text(rng, 90, 10**6), rnd_text(rng, 90, 10**6)
    rows = [(3, a + " end"), (5, a), (5, b), (9, b + " tail")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, KIND)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == near_by_row(rows) == [(3, 87, 3, True), (5, 86, 3, False), (5, 86, 5, True), (9, 87, 5, False)]


def test_near_dedup_random(spark):
    rows = random_rows(random.Random(7), 160)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, KIND).repartition(4)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == near_by_row(rows)


def test_near_dedup_percent(spark):
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_dedup(spark.createDataFrame([(1, "a")], KIND), percent=40)


@pytest.mark.parametrize("doubling", [False, True])
def test_substring_dedup(spark, doubling):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    first = letters(650)
    rows = [(1, first), (1, letters(900)), (2, first[:600]), (None, letters(300) + first[20:400]), (None, letters(500)), (3, letters(700)), (3, letters(260)), (3, None)]
    rows += [(4, rows[5][1]), (4, letters(800)), (4, rows[6][1])]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, KIND).repartition(3), doubling=doubling).collect()]
    want = [(rows[k][0], *x) for k, x in repeats(list(enumerate(t for _, t in rows)), 200).items()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    a, b = rnd_text(rng, 90, 10**6), rnd_text(rng, 90, 10**6)
    rows = [(3, a + " end"), (5, a), (5, b)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # language needs something to learn from; the rows are of one language
    got = sorted((r["doc_id"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((i, len(ids) + 1) for (i, _), ids in zip([rows[0], rows[2]], ids_of([rows[0][1], rows[2][1]]), strict=True))
