"""Hard negatives against every anchor meeting every row."""

import math
import random

import numpy as np
import pytest

from textloom.llm import hard_negatives

KIND = "vec_id long, label int, embedding array<float>, id string, score double, key int"


def expected(rows, every=50, positives=5, negatives=3, low=50, high=95):
    ok = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out, seen = [], set()
    for i, y, v in ok:
        if i % every or (i, y, tuple(v)) in seen:
            continue
        seen.add((i, y, tuple(v)))
        others = sorted((-dot(v, w), j, z) for j, z, w in ok if j != i)
        for s, p, _ in [o for o in others if o[2] == y][:positives]:
            band = [(t, j) for t, j, z in others if z != y and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(band)]
    return sorted(out)


def check(spark, rows, parts=6):
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], KIND).repartition(parts)
    got = hard_negatives.mine(df)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    want = expected(rows)
    assert sorted(map(tuple, got.collect())) == want
    return want


def clustered(rng, n, centres, dim=8, spread=0.05):
    """Labels vary inside the clusters; a third of all rows has one label."""
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(k, 3 if rng.random() < 0.33 else rng.randrange(6), [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for k in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SAMPLE": 300, "PIVOTS": 24, "BLOCK": 32, "CHUNK": 8, "GROUP": 16, "SLICES": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)


def test_clusters(spark, small):
    rows = clustered(random.Random(1), 2500, 12)
    assert len(check(spark, rows)) > 300


def test_groups_get_part_of_the_rows(spark, small, monkeypatch):
    """On clusters the bounds keep most rows from most groups."""
    seen = []
    whole = hard_negatives.summarise
    monkeypatch.setattr(hard_negatives, "summarise", lambda *a: seen.append((whole(*a), a[1])) or seen[-1][0])
    check(spark, clustered(random.Random(2), 2500, 12, spread=0.01))
    for bounds, space in seen:
        to = bounds.groups(space, space.rows, space.labels)
        assert to.shape[1] >= 4 and to.sum(1).mean() < 0.6 * to.shape[1]


def test_odd_rows(spark, small):
    rng = random.Random(3)
    rows = clustered(rng, 300, 3)
    rows += [(None, 1, [1.0] * 8), (1000, None, [1.0] * 8), (1050, 1, None), (1100, 1, [1.0, None] * 4), (1150, 1, [math.nan] * 8), (1200, 1, [math.inf] + [0.0] * 7)]
    rows += [(1250, 2, []), (1300, 2, [0.5]), (-50, 4, [0.3] * 8), (1350, -2, [-0.3] * 8)]
    rows += [(150, 1, [0.7] * 8), (150, 1, [0.7] * 8), (150, 2, [0.7] * 8), (301, 1, [0.7] * 8), (301, 1, [0.7] * 8), (301, 2, [0.6] * 8)]
    rows += [(2000 + k, k % 3, [0.25] * 8) for k in range(130)]  # ties, a very common vector
    rows += [(3000 + k, k % 2, [0.0] * 8) for k in range(60)]  # all scores 0
    check(spark, rows)


def test_few_rows(spark):
    for rows in ([], [(1, 1, [1.0])], [(50, 1, [1.0])], [(50, 1, [1.0]), (51, 1, [0.9]), (52, 2, [0.6])], [(0, 1, []), (1, 1, []), (2, 2, [])]):
        check(spark, rows, 2)


def test_large_numbers(spark, small):
    rng = random.Random(4)
    check(spark, [(k, k % 4, [rng.uniform(-1, 1) * 3e5 for _ in range(8)]) for k in range(400)])
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(spark.createDataFrame([(50, 1, [1e30])], "vec_id long, label int, embedding array<float>"))
