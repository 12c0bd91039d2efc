"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from textloom.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(text, longest=1):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [b" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def expected(docs, target, longest=1, percent=10, least=20, buckets=10_000):
    counts = [Counter(zlib.crc32(f) % buckets for _, t in rows for f in found(t, longest)[1]) for rows in (docs, target)]
    (s, t), (s_all, t_all) = counts, [sum(c.values()) for c in counts]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out, able = [], []
    for i, text in docs:
        n, fs = found(text, longest)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if n >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "Day", "naïve", "x9", "rain-fall", "İstanbul", "été", "日本"]) + rng.choice(["", ".", str(rng.randrange(40))]) for _ in range(n))
    docs = [(1, None), (2, ""), (3, "..."), (None, text(40)), (4, text(19)), (5, text(20)), (6, "x" * 200 + " " + text(30000))]
    docs += [(7 + k, text(rng.randrange(1, 90))) for k in range(120)]
    same = text(60)
    return docs + [(500 + k, same) for k in range(60)] + [docs[40], docs[40]], [(1, text(50)), (2, None), (3, "Rain the day")]


@pytest.mark.parametrize("longest", [1, 2])
def test_resample(spark, rows, longest, monkeypatch):
    monkeypatch.setattr(importance, "PART", 500)  # the workers are forked and have it too, or split less often
    docs, target = rows
    # columns with clashing names are not read
    df = spark.createDataFrame([(i, t, 1, "s", 2.0) for i, t in docs], "doc_id long, text string, id int, score string, rank double").repartition(5)
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = importance.resample(df, goal, percent=30, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(docs, target, longest, 30)


def test_resample_empty(spark):
    none, goal = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resample(none, goal).count() == 0
    docs = [(k, f"word{k} " * 25) for k in range(20)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), none)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(docs, [])
