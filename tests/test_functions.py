"""Text functions and operators against plain Python statements of their rules."""

import csv
import itertools
import json
import math
import random
import re
import statistics
import time
import unicodedata
import urllib.error
import urllib.request
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import features, udf
from textloom.functions import text as tx
from textloom.operators import allocation, ml, pairs, quality, ranking, stats
from textloom.sources import connectors, files, jsonl
from textloom.streaming import resume, windows

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]
TRICKY = [
    "", " ", "a", "  a\tb\n", "a b c", "one​two﻿x", "x".join(SPACES), "ක්‍රි hello ක්‍ර්abc රි", "abc ක්‍x y", "!!! .... >>>> ,,;;", "“q” ‘r’ «s» `t` –—−",
    "é à  ​‍ x", "😀 hi 😀😀 🇱🇰 1️⃣ ❤️", "[[File:a.jpg|thumb|x]] {{t}} link= photo.png thumbs thumb", "File : x.y Image:z ිthumb", "a\n\n\n\nb \n c", "Dr. X met A. B. Silva.\nIt was 3.14 or 1,250.50... \"No. Stop!\" he said. ok",
    "He said (yes.) Then left.No space. end", "123\nSome words without stop here\nok", "1. 2. 3.", "What?! Really… yes", "‘a. b’ c. d “e. f. Is unbalanced. Yes it is.",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TRICKY)), "i int, t string").coalesce(1).cache()


def column(df, c):
    return [r[1] for r in sorted(df.select("i", c.alias("x")).collect())]


def test_words_and_trim(texts):
    assert column(texts, tx.words(F.col("t"))) == [t.split() for t in TRICKY]
    assert column(texts, tx.utrim(F.col("t"))) == [t.strip() for t in TRICKY]


def latin(word):
    return bool(re.search("[A-Za-z]", word)) and not re.search("[඀-෿]", word)


def test_latin(texts):
    want = ["".join("<LAT>" if latin(p) else p for p in re.split(r"(\s+)", t)) for t in TRICKY]
    assert column(texts, tx.latin_to_placeholder(F.col("t"))) == want
    assert column(texts, tx.latin_count(F.col("t"))) == [sum(map(latin, t.split())) for t in TRICKY]


def test_emoji_and_markup(texts):
    run = re.compile("[\U0001f300-\U0001faff☀-➿\U0001f1e6-\U0001f1ff←-⇿⬀-⯿]+")
    assert column(texts, tx.strip_emoji(F.col("t"))) == [run.sub("", t) for t in TRICKY]
    assert column(texts, tx.count_emoji(F.col("t"))) == [len(run.findall(t)) for t in TRICKY]
    got = dict(zip(TRICKY, column(texts, tx.strip_markup(F.col("t"))), strict=True))
    assert got["[[File:a.jpg|thumb|x]] {{t}} link= photo.png thumbs thumb"].split() == []  # link= takes the next word, once the file name is gone
    assert got["File : x.y Image:z ිthumb"].split() == ["ි"]
    assert got["a b c"] == "a b c"


def test_tidy(texts):
    def want(t):
        t = unicodedata.normalize("NFC", t)
        t = t.translate(str.maketrans(tx.QUOTES_FROM + tx.DASHES_FROM, tx.QUOTES_TO + tx.DASHES_TO))
        t = re.sub(r"([!?.,;:\-_*#~])\1+", r"\1", t)
        t = re.sub("\n{3,}", "\n\n", re.sub(tx.SPACE_RUN, " ", t))
        return "\n".join(x.strip() for x in t.split("\n")).strip()

    assert column(texts, tx.tidy(udf.nfc(F.col("t")))) == [want(t) for t in TRICKY]
    twice = tx.tidy(udf.nfc(tx.tidy(udf.nfc(F.col("t")))))
    assert column(texts, twice) == [want(want(t)) for t in TRICKY]


def test_segmenter():
    s = udf.split_sentences
    assert s("Dr. X met A. B. Silva. It was 3.14 today.") == ["Dr. X met A. B. Silva.", "It was 3.14 today."]
    assert s('He said "No. Stop." Then he left.') == ['He said "No. Stop." Then he left.']
    assert s("Wait... what happened? Nothing (really.) Good.") == ["Wait...", "what happened?", "Nothing (really.)", "Good."]
    assert s('"One. " Two. "Three." Four') == ['"One. " Two. "Three." Four']
    assert s('"One. " Two. "Three." Four and more') == ['"One. " Two.', '"Three." Four and more']
    assert s("Left.No space here. End of it.") == ["Left.No space here.", "End of it."]
    assert s("123\nSome words without a stop\nok") == ["123 Some words without a stop ok"]
    assert s("") == s(" \n ") == s(None) == []
    assert s("An unbalanced “quote. It still ends. Yes.") == ["An unbalanced “quote.", "It still ends.", "Yes."]


def test_stem():
    rng = random.Random(1)
    words = ["".join(rng.choice("abct") for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    suffixes = ["a", "ta", "cta", "bb", "t"]

    def want(w):
        fits = [s for s in suffixes if w.endswith(s) and len(w) - len(s) >= 2]
        return w[: len(w) - len(max(fits, key=len))] if fits else w

    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame(list(enumerate(words)), "i int, t string")
    assert column(df, tx.stem(F.col("t"), suffixes)) == [want(w) for w in words]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 49, 50, 51, 120])
def test_features(spark, n):
    rng = random.Random(n)
    w = [rng.choice("abcdefghijk") * rng.randrange(1, 4) for _ in range(n)]
    row = features.feature_table(spark.createDataFrame([(1, " ".join(w))], "id int, text string"), keys=["id"]).first()
    ttr = len(set(w)) / n if n else 0.0
    mattr = statistics.mean(len(set(w[i : i + 50])) / 50 for i in range(n - 49)) if n > 50 else ttr
    grams = lambda k: [tuple(w[i : i + k]) for i in range(n - k + 1)]
    assert row["ttr"] == pytest.approx(ttr) and row["mattr"] == pytest.approx(mattr)
    for k, name in ((2, "bigram_diversity"), (3, "trigram_diversity")):
        assert row[name] == pytest.approx(len(set(grams(k))) / len(grams(k)) if n >= k else 0.0)
    assert row["avg_sentence_length"] == n and row["sentence_length_sd"] == 0 and row["doc_len_words"] == n
    assert row["herdan_c"] == pytest.approx(math.log(len(set(w))) / math.log(n) if n > 1 and len(set(w)) > 1 else 0.0)


def test_quality(spark):
    rows = [(0, None), (1, "ප්‍රවර්ගය:a\n ප්‍රවර්ගය:b"), (2, "x [[File:y]]"), (3, "РџСЂРёРІРµС‚ мир"), (4, "Text.Category:A\nmore\n\n\nCategory: B\n"), (5, "no category: here"), (6, "සිංහල පෙළ a")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r for r in quality.quality_flags(df, min_words=1).collect()}
    assert not got[1]["not_category_only"] and not got[2]["no_residual_markup"] and not got[3]["no_encoding_corruption"] and not got[0]["sufficient_length"]
    assert got[4]["_body"] == "Text.\nmore" and got[5]["_body"] == "no category: here" and got[6]["sufficient_script"] and not got[5]["sufficient_script"]
    clean, rejected = quality.clean_and_rejected(df, min_words=1)
    assert clean.count() + rejected.count() == len(rows) and clean.columns == df.columns
    old, new = quality.date_partition(spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2020-01-01'), (2, NULL), (3, TIMESTAMP '2023-01-01') AS t(id, d)"), ["d"], "2022-11-30")
    assert [r["id"] for r in old.collect()] == [1] and sorted(r["id"] for r in new.collect()) == [2, 3]


def test_prompt_slots_are_not_expanded_again(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    assert df.select(tx.fill("<{a}|{b}|{c}>", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "<{b}||{c}>"


def test_ranks_and_splits(spark):
    df = spark.range(500).withColumnRenamed("id", "doc")
    ranked = {r["doc"]: r["rn"] for r in ranking.shuffle_rank(df, "doc", 42).collect()}
    import hashlib

    order = sorted(range(500), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert ranked == {i: k + 1 for k, i in enumerate(order)}
    s = allocation.model_slices(df, "doc", ["a", "b"], 100)
    assert s.count() == 200 and s.select("doc").distinct().count() == 200 and allocation.overlaps(s, "doc", ["model"]).count() == 0
    with pytest.raises(ValueError):
        allocation.model_slices(df, "doc", ["a", "b"], 300)
    m = allocation.modes(s, {"x": (10, 3), "y": (7, 2)}, ["model"])
    assert sorted((r["mode"], r["variant"], r["count"]) for r in m.filter("model = 'a'").groupBy("mode", "variant").count().collect()) == [("x", 0, 4), ("x", 1, 3), ("x", 2, 3), ("y", 0, 4), ("y", 1, 3)]
    split = allocation.three_way(df.withColumn("g", F.floor(F.col("doc") / 2)), "g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_statistics(spark):
    rng = random.Random(0)
    rows = [(k // 2, "m", s, k % 2, int(rng.random() < 0.3 + 0.4 * (k % 2)), rng.randrange(5)) for k in range(120) for s in (1, 2)]
    df = spark.createDataFrame(rows, "pair int, model string, seed int, label int, pred int, score int")
    one = [r for r in rows if r[2] == 1]
    pos, neg = [r[5] for r in one if r[3]], [r[5] for r in one if not r[3]]
    auc = sum((a > b) + (a == b) / 2 for a, b in itertools.product(pos, neg)) / len(pos) / len(neg)
    assert stats.roc_auc(df.filter("seed = 1"), [], "label", "score").first()[0] == pytest.approx(auc)
    reps = stats.paired_bootstrap(df, "pair", "model", "seed", n_boot=600, chunk=100)
    got = reps.agg(F.count("*"), F.avg("macro_f1"), F.stddev_samp("macro_f1")).first()

    def f1(part):
        c = lambda y, p: sum(1 for r in part if (r[3], r[4]) == (y, p))
        return (2 * c(1, 1) / max(2 * c(1, 1) + c(0, 1) + c(1, 0), 1) + 2 * c(0, 0) / max(2 * c(0, 0) + c(0, 1) + c(1, 0), 1)) / 2

    plain = []
    for _ in range(600):
        picks = [rng.randrange(60) for _ in range(60)]
        plain.append(statistics.mean(f1([one_pair for g in picks for one_pair in rows[g * 4 : g * 4 + 4] if one_pair[2] == s]) for s in (1, 2)))
    assert got[0] == 600 and got[1] == pytest.approx(statistics.mean(plain), abs=0.02) and got[2] == pytest.approx(statistics.stdev(plain), rel=0.25)
    for n in (1, 7):  # dealt over shards of few patterns, the draws have the same law
        dealt = stats.paired_bootstrap(df, "pair", "model", "seed", n_boot=600, chunk=100, shard_rows=n).agg(F.count("*"), F.avg("macro_f1"), F.stddev_samp("macro_f1")).first()
        assert dealt[0] == 600 and dealt[1] == pytest.approx(statistics.mean(plain), abs=0.02) and dealt[2] == pytest.approx(statistics.stdev(plain), rel=0.25)
    assert udf.binomial_two_sided(2, 10) == pytest.approx(2 * sum(math.comb(10, i) for i in range(3)) / 1024) and udf.binomial_two_sided(5, 10) == 1
    const = stats.cohens_d(df.withColumn("one", F.lit(1.0)).withColumn("s", F.col("score").cast("double")), [], ["one", "s"]).collect()
    assert {r["feature"]: r["cohens_d"] is None for r in const} == {"one": True, "s": False}
    p = spark.createDataFrame([(-1.0,), (0.5,), (0.7,), (0.9,)], "d double").agg(stats.bootstrap_p(F.col("d"), 4)).first()[0]
    assert p == pytest.approx(0.5)


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert df.select(pairs.mean_pool(F.col("v"), F.col("m"))).first()[0] == pytest.approx([math.sqrt(0.5)] * 2)
    unit = F.slice("v", 1, 2)
    assert df.select(pairs.greedy_f1(unit, unit)).first()[0] == pytest.approx(1.0)
    assert df.select(pairs.cosine(F.col("v")[0], F.col("v")[1])).first()[0] == 0


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "b c d")], "id int, t string")
    got = {(r["id"], r["term"]): r["weight"] for r in ml.tfidf(df, "id", "t", (1,), 2).collect()}
    idf = math.log(4 / 3) + 1
    raw = {"a": (1 + math.log(2)) * idf, "b": idf}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got[1, "a"] == pytest.approx(raw["a"] / norm) and (3, "d") not in got
    assert df.filter("id = 2").select(ml.char_ngrams(F.col("t"), 2, 3)).first()[0] == [" a", "a ", " a ", " c", "c ", " c "]


def newton(x, y, c, penalised):
    """Weights of L2 logistic regression, sum of losses times c, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + np.diag(penalised), c * x.T @ (p - y) + penalised * w)
    return w


def test_tfidf_experiment(spark):
    """Scores and chosen strength equal a plain computation over dictionaries and a fit by Newton's method."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        label = k % 2
        text = " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"] if rng.random() < 0.6 else (["xy", "xz"] if label else ["yx", "zx"])) for _ in range(rng.randint(1, 9)))
        rows.append((k, None if k == 7 else text, label, ("train", "train", "dev", "test")[k // 2 % 4], "d" + str(k % 3)))
    df = spark.createDataFrame(rows, "id int, text string, label int, split string, domain string")
    summary, domains = ml.tfidf_experiment(df, "id")

    def terms(text):
        w = (text or "").split()
        return Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)])

    train = [terms(r[1]) for r in rows if r[3] == "train"]
    df_of = Counter(t for c in train for t in c)
    known = sorted(t for t in df_of if df_of[t] >= 2)

    def vector(text):
        c = terms(text)
        v = np.array([(1 + math.log(c[t])) * (math.log((1 + len(train)) / (1 + df_of[t])) + 1) if c[t] else 0.0 for t in known])
        return np.append(v / (np.linalg.norm(v) or 1.0), 1.0)

    def part(name):
        return np.array([vector(r[1]) for r in rows if r[3] == name]), np.array([r[2] for r in rows if r[3] == name])

    def macro_f1(y, p):
        return sum(2 * ((y == k) & (p == k)).sum() / max(1, (y == k).sum() + (p == k).sum()) for k in (0, 1)) / 2

    best = None
    for c in (0.1, 1.0, 10.0, 100.0):
        x, y = part("train")
        w = newton(x, y, c, np.ones(x.shape[1]))
        x, y = part("dev")
        if best is None or macro_f1(y, x @ w > 0) > best[0]:
            best = (macro_f1(y, x @ w > 0), c, w)
    x, y = part("test")
    assert summary["n_terms"] == len(known) and summary["c"] == best[1]
    assert summary["dev_macro_f1"] == pytest.approx(best[0]) and summary["test_macro_f1"] == pytest.approx(macro_f1(y, x @ best[2] > 0))
    s = x @ best[2]
    auc = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert summary["test_roc_auc"] == pytest.approx(auc) and [d["domain"] for d in domains] == ["d0", "d1", "d2"]
    with pytest.raises(ValueError):
        ml.tfidf_experiment(df.filter("label = 1"), "id")


def test_penalised_fits_go_down_together(spark):
    """Frequent and rare features: all strengths reach Newton's loss, in few jobs for all of them."""
    rng = np.random.default_rng(5)
    x = np.hstack([rng.random((300, 30)) * (rng.random((300, 30)) < 0.5 ** np.arange(30)), np.ones((300, 1))])
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) / 4 > 0).astype(int)
    rows = [(int(k), np.flatnonzero(v).astype(np.int32), v[v != 0]) for k, v in zip(y, x, strict=True)]
    blocks = spark.sparkContext.parallelize(range(300), 3).mapPartitions(lambda part: ml.in_blocks(rows[k] for k in part)).persist()
    grid = (0.1, 1.0, 10.0, 100.0)
    spark.sparkContext.setJobGroup("fits", "fits")
    got = ml.penalised(blocks, x.shape[1], 300, grid)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fits")) < 120
    spark.sparkContext.setJobGroup("", "")
    for c, w in zip(grid, got, strict=True):
        loss = lambda v, c=c: c * np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + v @ v / 2
        assert loss(w) <= loss(newton(x, y, c, np.ones(x.shape[1]))) * (1 + 1e-4)


def test_strong_constant_takes_few_steps():
    """A constant beside short rows of terms, as TF-IDF has it: Newton's loss in few steps (65 when the constant went like a term)."""
    rng = np.random.default_rng(6)
    n, d, c = 400, 500, 100.0
    x = rng.random((n, d)) * (rng.random((n, d)) < 1 / (1 + np.arange(d) / 10))
    x = np.hstack([x / np.linalg.norm(x, axis=1)[:, None], np.ones((n, 1))])
    y = (x[:, :20] @ rng.normal(size=20) > -0.35).astype(int)
    run, steps = ml.descend(d + 1, 1 / (c * n)), 0
    w = next(run)
    try:
        while True:
            steps, m = steps + 1, x @ w
            w = run.send(((np.logaddexp(0, m) - y * m).mean() + w @ w / (2 * c * n), x.T @ (1 / (1 + np.exp(-m)) - y) / n + w / (c * n)))
    except StopIteration as done:
        got = done.value
    loss = lambda v: c * np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + v @ v / 2
    assert steps < 45 and loss(got) <= loss(newton(x, y, c, np.ones(d + 1))) * (1 + 1e-4)


TERM_TEXTS = ["a bb  a\u00a0ccc a\x1cbb", " ", "", None, "x", "\U0001f600 d\u00e9j\u00e0 d\u00e9j\u00e0", "it\u2019s its \u0fff\u1000 \u0fff\u0fff \u4e2d\u6587", "a\x00b a\x01b abcdefghij", "\u2019"]


@pytest.mark.parametrize(("ngrams", "chars"), [((1, 2), False), ((2, 5), True), ((1, 3), True), ((3, 12), True)])
def test_keys_of_terms(spark, monkeypatch, ngrams, chars):
    """Terms counted by keys, and places in vectors, equal the terms as strings, with characters that don't fit into a key too; whatever a task counts at once."""
    of = [ml.terms_of(t, ngrams, chars) for t in TERM_TEXTS]
    known = sorted({t for c in of for t in c})[::2]
    rows = pa.RecordBatch.from_pydict({"text": TERM_TEXTS, "id": list(range(len(TERM_TEXTS)))})
    idf = np.arange(1.0, len(known) + 1)
    for row, at, weight in ml.vectors([rows], (ml.places_of(known, ngrams, chars), idf), ngrams, chars):
        want = {k: (1 + math.log(of[row["id"]][t])) * idf[k] for k, t in enumerate(known) if t in of[row["id"]]}
        norm = math.sqrt(sum(v * v for v in want.values())) or 1.0
        got = dict(zip(at.tolist(), weight.tolist(), strict=True))
        assert len(got) == len(at) and got == pytest.approx({k: v / norm for k, v in want.items()} | {len(known): 1.0})
    df = spark.createDataFrame([(t,) for t in TERM_TEXTS], "text string").coalesce(1)
    rows_with = Counter(t for c in of for t in c)
    want = {t: math.log((1 + len(TERM_TEXTS)) / (1 + k)) + 1 for t, k in rows_with.items() if k >= 2}
    total = sum(of, Counter())
    order = sorted(want, key=lambda t: (-total[t], t.encode()))
    for name, value in (("COUNTED", 250_000), ("COUNTED", 4), ("AT_ONCE", 10)):
        monkeypatch.setattr(ml, name, value)
        got = ml.frequent_terms(df, len(TERM_TEXTS), ngrams, 2, chars, 1000).collect()
        assert [r["term"] for r in got] == order and [r["idf"] for r in got] == pytest.approx([want[t] for t in order])


@pytest.mark.parametrize(("ngrams", "chars"), [((1, 2), False), ((2, 5), True)])
def test_terms_of_texts(spark, ngrams, chars):
    texts = ["a bb  a\u00a0ccc a\x1cbb", " ", "", "x", "\U0001f600 d\u00e9j\u00e0 d\u00e9j\u00e0"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r["id"], r["term"]): r["tf"] for r in ml.term_counts(df, "id", "t", ngrams, chars).collect()}
    assert got == {(k, term): n for k, t in enumerate(texts) for term, n in ml.terms_of(t, ngrams, chars).items()}


def test_logistic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2)) * [3, 1] + [5, 0]
    y = (x[:, 0] - 5 + rng.normal(size=50) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, y, strict=True)], "a double, b double, label int")
    got = sorted((r["a"], r["score"]) for r in ml.predict(ml.logistic(df, ["a", "b"], c=1.0), df, ["a"]).collect())
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(50)])
    p = 1 / (1 + np.exp(-z @ newton(z, y, 1.0, np.array([1.0, 1.0, 0.0]))))
    assert [s for _, s in got] == pytest.approx(list(p[np.argsort(x[:, 0])]), abs=1e-4)


def test_jsonl(spark, tmp_path):
    full = dict.fromkeys(jsonl.FIELDS) | {"text_id": "t1", "label": 1, "domain": "d", "source_id": "s", "generation_mode": "m", "prompt_id": "p"}
    lines = [json.dumps(full), "", "  ", json.dumps({k: v for k, v in full.items() if k != "text"}), '{"text_id": "x", "so', json.dumps(full | {"text_id": "t2", "text": "ක"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "merged_a.jsonl").write_text(lines[0])
    read = jsonl.read_lines(spark, f"{tmp_path}/*.jsonl")
    valid, invalid = jsonl.validate(read)
    assert sorted(r["text_id"] for r in valid.collect()) == ["t1", "t2"] and invalid.count() == 2
    assert [tuple(r) for r in jsonl.completed_keys(read).collect()] == [("s", "m", "p")]
    jsonl.write_by_domain(valid.drop("file", "pos"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    (tmp_path / "cache").write_text('{"id": "1", "a": "x"}\n{"id": "1", "b": "y"}\n{"id": "1", "a": null}\n{"id": "2", "b": "z"}\n{"id"')
    got = {r["id"]: (r["a"], r["b"]) for r in jsonl.merge_fields(jsonl.read_lines(spark, f"{tmp_path}/cache", None), "id", ["a", "b"]).collect()}
    assert got == {"1": (None, "y"), "2": (None, "z")}


def test_files(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"Headline": "h", "News Content": "t\nu"}, {"Headline": "i", "News Content": None}]))
    news = files.read_source(spark, f"{tmp_path}/n.json", "news")
    assert [(r["source_id"], r["title"]) for r in news.orderBy("source_id").collect()] == [("0", "h"), ("1", "i")]
    (tmp_path / "s.csv").write_text('Message,x\n"a ""q"",\nb",1\n')
    assert files.read_source(spark, f"{tmp_path}/s.csv", "social_media").first()["caption"] == 'a "q",\nb'
    with pytest.raises(ValueError):
        files.read_source(spark, f"{tmp_path}/s.bin")
    ids = spark.createDataFrame([("10",), ("0",), ("1",)], "source_id string")
    assert [(r["source_id"], r["status"]) for r in files.lookup(ids, news, "human_text").collect()] == [("0", "found"), ("1", "empty"), ("10", "missing")]
    assert files.needed_rows(news, ids).count() == 2
    (tmp_path / "runs.csv").write_text('run_id,phase,f,budget\na,p,1,"{""d"": 128}"\nb,q,2,\na,p,3,"{""d"": 256}"\n')
    runs = {r["run_id"]: r for r in files.read_runs(spark, f"{tmp_path}/runs.csv").collect()}
    assert runs["a"]["f"] == 3 and runs["a"]["budget"] == {"d": 256} and len(runs) == 2
    report = spark.createDataFrame([("m", 0.5), ("n", None)], "model string, f double")
    files.write_report(report, f"{tmp_path}/r", ("csv", "md", "tex"))
    assert files.markdown(report).splitlines()[2] == "| m | 0.5 |" and r"\textbf{0.5}" in files.latex(report, "f")


def test_connectors(spark):
    prompts = spark.createDataFrame([(str(k), "m", f"p{k}") for k in range(40)], "id string, model string, prompt string")
    got = connectors.generate(prompts, connectors.FakeModel(), sleep=lambda s: None).collect()
    assert len(got) == 40 and all(r["error"] is None for r in got) and any(r["billed_output"] > r["output_tokens"] for r in got)
    waits = []

    def failing(state=[0]):  # noqa: B006
        state[0] += 1
        if state[0] < 4:
            raise connectors.Retryable("busy", 7.0 if state[0] == 2 else None)
        return connectors.Reply("ok")

    assert connectors.retried(failing, sleep=waits.append).text == "ok" and waits == [1.0, 7.0, 4.0]
    dates = {r["id"]: r for r in connectors.with_dates(spark.createDataFrame([("1",), ("7",), ("x",)], "id string"), connectors.FakeHistory()).collect()}
    assert dates["1"]["created"] and dates["7"]["last_modified"] is None and dates["x"]["created"] is None


def test_http(monkeypatch):
    """Retries, asked waits, the deadline against a dripping connection, keys, and typed errors, against a local server."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def send(self, state, body, **head):
            self.send_response(state)
            for k, v in head.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            seen[self.path] += 1
            if self.path.startswith("/busy") and seen[self.path] == 1:
                self.send(429, b"", Retry_After="9")
            elif self.path.startswith("/busy") and seen[self.path] == 2:
                self.send(200, b'{"error": {"code": "maxlag"}}')
            elif self.path.startswith("/none"):
                self.send(404, b"")
            elif self.path.startswith("/drip"):
                self.send_response(200)
                self.end_headers()
                try:
                    for _ in range(100):
                        self.wfile.write(b" ")
                        time.sleep(0.05)
                except OSError:
                    pass
            else:
                self.send(200, b'{"a": 1}')

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            cut = asked["max_tokens"] < 16384
            reply = {"choices": [{"message": {"content": None if asked["messages"][0]["content"] == "mute" else self.headers["Authorization"]}, "finish_reason": "length" if cut else "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}
            self.send(200, json.dumps(reply).encode())

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        waits = []
        assert connectors.get_json(f"{base}/busy", {"q": "x y"}, sleep=waits.append) == {"a": 1} and waits == [9.0, 2.0]
        with pytest.raises(urllib.error.HTTPError):
            connectors.get_json(f"{base}/none", {})
        began = time.monotonic()
        with pytest.raises(connectors.DeadlineExceeded):
            connectors.answer(urllib.request.Request(f"{base}/drip"), 0.4)
        assert time.monotonic() - began < 3
        client = connectors.ChatService(f"{base}/chat", "TEST_SERVICE_KEY")
        monkeypatch.delenv("TEST_SERVICE_KEY", raising=False)
        with pytest.raises(connectors.MissingKey):
            client.complete("m", "p", 10)
        monkeypatch.setenv("TEST_SERVICE_KEY", "k")
        assert client.complete("m", "p", 8192) == connectors.Reply("Bearer k", 3, 4, True)
        assert client.complete("m", "mute", 16384) == connectors.Reply(None, 3, 4, False)
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(connectors.Retryable):
        connectors.answer(urllib.request.Request(f"{base}/gone"), 1.0)


def test_splits_and_sinks(spark, tmp_path):
    def part(name, n):
        rows = [(f"{name}{k}", f"{name}{k // 2}", k % 2, "ab"[k // 2 % 2], f"word {k}", name) for k in range(n)]
        return spark.createDataFrame(rows, "text_id string, group string, label int, domain string, text string, source string").coalesce(1)

    parts = {"train": part("t", 8), "validation": part("v", 4), "test": part("s", 4)}
    whole = files.read_splits(parts, expected=16, sizes={"train": 8, "dev": 4, "test": 4}, unpunctuated="a")
    want = [r["text_id"] for _, p in parts.items() for r in sorted(p.collect(), key=lambda r: (r["label"], r["domain"]))]
    got = whole.collect()
    assert [r["text_id"] for r in sorted(got, key=lambda r: r["pos"])] == want and {r["split"] for r in got} == {"train", "dev", "test"}
    with pytest.raises(ValueError, match="size_dev: 1"):
        files.require(whole, sizes={"dev": 5})
    with pytest.raises(ValueError, match="punctuation: 1"):
        files.require(whole.withColumn("text", F.when(F.col("text_id") == "t0", "a <LAT>.").otherwise("a <LAT>")), unpunctuated="a")
    with pytest.raises(ValueError, match="row_count|pair_size"):
        files.read_splits(parts | {"test": part("s", 3)}, expected=16)
    with pytest.raises(FileNotFoundError):
        files.read_corpus(spark, f"{tmp_path}/none")
    whole.write.parquet(f"{tmp_path}/corpus")
    assert files.read_corpus(spark, f"{tmp_path}/corpus", 16).count() == 16

    log = lambda f: spark.createDataFrame([("r1", "p", f)], "run_id string, phase string, f double").coalesce(1)
    for f in (0.1, 0.2):
        files.append_csv(log(f), f"{tmp_path}/log")
    assert spark.read.csv(f"{tmp_path}/log", header=True).count() == 2 and files.read_runs(spark, f"{tmp_path}/log").count() == 1
    rejected = spark.createDataFrame([("1", 'පෙළ "x",\ny')], "source_id string, text string").coalesce(1)
    files.write_rejected(rejected, f"{tmp_path}/rejected")
    (file,) = (tmp_path / "rejected").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfsource_id")
    with open(file, encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f)) == [["source_id", "text"], ["1", 'පෙළ "x",\ny']]
    for run, pred in (("a|1", 0), ("b|1", 1), ("a|1", 1)):
        files.write_predictions(spark.createDataFrame([(run, "t", pred)], "run_id string, text_id string, pred int"), f"{tmp_path}/preds")
    assert sorted((r["run_id"], r["pred"]) for r in spark.read.parquet(f"{tmp_path}/preds").collect()) == [("a|1", 1), ("b|1", 1)]
    cache = lambda **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).coalesce(1)
    jsonl.append_lines(cache(id="1", a="x"), f"{tmp_path}/lines")
    jsonl.append_lines(cache(id="1", b=None), f"{tmp_path}/lines")
    assert tuple(jsonl.merge_fields(jsonl.read_lines(spark, f"{tmp_path}/lines", None), "id", ["a", "b"]).first()) == ("1", "x", None)

    state = lambda m, n: spark.createDataFrame([("d", m, n)], "domain string, model string, completed_count int")
    for version, (m, n) in enumerate([("m", 1), ("n", 1), ("m", 5)]):
        resume.upsert(state(m, n), f"{tmp_path}/progress", version)
    resume.upsert(state("m", 6), f"{tmp_path}/progress", 2)
    assert sorted((r["model"], r["completed_count"]) for r in resume.present(spark, f"{tmp_path}/progress", ["domain", "model"]).collect()) == [("m", 6), ("n", 1)]
    points = spark.createDataFrame([(float(k), float(k % 7), k % 2) for k in range(20)], "a double, b double, label int")
    ml.save_model(ml.logistic(points, ["a", "b"]), f"{tmp_path}/model")
    assert ml.predict(ml.load_model(f"{tmp_path}/model"), points, ["a"]).count() == 20


def test_cache_and_best_streams(spark, tmp_path):
    ids = spark.createDataFrame([(str(k),) for k in range(30)], "id string")
    ids.repartition(3).write.parquet(f"{tmp_path}/ids")
    for more in (0, 1):
        if more:
            spark.createDataFrame([("1",), ("101",)], "id string").write.mode("append").parquet(f"{tmp_path}/ids")
        stream = spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ids")
        resume.fill_cache(stream, f"{tmp_path}/cache", f"{tmp_path}/c1", connectors.FakeHistory(), workers=2).awaitTermination()
    got = [r["id"] for r in spark.read.parquet(f"{tmp_path}/cache").collect()]
    assert len(got) == len(set(got)) == 31
    runs = spark.createDataFrame([("m", 2, 0.5), ("m", 3, 0.7), ("m", 1, 0.7), ("n", 1, None), ("n", 2, 0.1)], "run string, epoch int, f double")
    want = [("m", 0.7, 1), ("n", 0.1, 2)]
    assert sorted(map(tuple, resume.running_best(runs, ["run"], "f", ["epoch"]).collect())) == want
    runs.repartition(2).write.parquet(f"{tmp_path}/runs")
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/runs")
    q = resume.running_best(stream, ["run"], "f", ["epoch"]).writeStream.outputMode("complete").format("memory").queryName("best").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("best").collect())) == want


def test_streams(spark, sf_dir, tmp_path):
    """Streaming windows equal batch windows; a resumed stream adds nothing twice."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windows.tumbling(events, "1 hour").select("start", "event_type", "n")
    assert sorted(map(tuple, spark.table("w").select("start", "event_type", "n").collect())) == sorted(map(tuple, batch.collect()))
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        resume.run_resumable(stream.select("event_id", "user_id", "event_type"), f"{tmp_path}/out", ["user_id", "event_type"], f"{tmp_path}/ckpt").awaitTermination()
        (tmp_path / "extra").mkdir(exist_ok=True)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("user_id", "event_type").distinct().count() == events.select("user_id", "event_type").distinct().count()
    assert resume.latest(out, ["user_id"], "event_id").count() == events.select("user_id").distinct().count()


def test_long_tokens_and_long_texts_take_linear_time(spark):
    import time

    files = "see a.jpg/b.png?x.gif and c.JPG.txt d.webp, .png end"
    assert column(spark.createDataFrame([(1, files)], "i int, t string"), F.regexp_replace("t", tx.MARKUP[3], "|")) == ["see | and |.txt |, .png end"]
    began = time.time()
    column(spark.createDataFrame([(1, "x" * 200_000), (2, "y" * 100_000 + ".jpg")], "i int, t string"), tx.strip_markup(F.col("t")))
    many = spark.createDataFrame([(1, "One two three. " * 20_000)], "id int, text string")
    assert features.feature_table(many, keys=["id"]).first()["sentence_length_sd"] == pytest.approx(0, abs=0.1)
    assert udf.split_sentences('"a b." ' * 20_000)
    assert time.time() - began < 120


def test_sorted_rank_of_few_values(spark):
    """A sort key with two values and nulls: the ranks are global all the same."""
    from textloom.operators import ranking

    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(3)) for k in range(3000)]
    rng.shuffle(rows)
    got = ranking.sorted_rank(spark.createDataFrame(rows, "id int, s string, v int").repartition(5), ["s", "v", "id"], "r", parts=7).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2], r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["r"])] == [r[0] for r in want] and sorted(r["r"] for r in got) == list(range(1, 3001))
    assert ranking.sorted_rank(spark.createDataFrame([], "id int"), ["id"]).count() == 0


def test_line_order_over_files(spark, tmp_path):
    """The last line wins over several files, the longer one read first or not; positions go on from file to file."""
    from textloom.sources import files, jsonl

    (tmp_path / "a.jsonl").write_text('{"k": "1", "v": "old"}\n')
    (tmp_path / "b.jsonl").write_text("\n".join('{"k": "%d", "v": "x"}' % k for k in range(2, 500)) + '\n{"k": "1", "v": "new"}\n')
    got = {r["k"]: r["v"] for r in jsonl.merge_fields(jsonl.read_lines(spark, str(tmp_path)), "k", ["v"]).collect()}
    assert got["1"] == "new" and len(got) == 499
    rows = files.read_source(spark, str(tmp_path), format="jsonl").collect()
    first = [(r["source_id"], r["k"], r["v"]) for r in sorted(rows, key=lambda r: int(r["source_id"]))]
    assert first[:3] == [("0", "1", "old"), ("1", "2", "x"), ("2", "3", "x")] and first[-1] == ("499", "1", "new")


def test_checks_are_computed_once(spark, sf_dir):
    """A filter on the checks doesn't compute them anew: the patterns stand once in the plan."""
    from textloom import catalog

    for name in ("quality_rejected", "quality_clean"):
        optimized = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count(quality.FOREIGN) == 1 and optimized.count(quality.CATEGORY_LINE) == 2  # found, then cut


def test_trim_and_stems_without_patterns(spark):
    """Ends are trimmed of all white space without a pattern; stems are made of distinct words only."""
    space = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    df = spark.createDataFrame([(1, f"{space}a{space}b{space}"), (2, space), (3, ""), (4, None), (5, "​x﻿"), (6, "a\r\n")], "id int, text string")
    trimmed = df.select("id", tx.utrim(F.col("text")).alias("t"))
    assert {r["id"]: r["t"] for r in trimmed.collect()} == {1: f"a{space}b", 2: "", 3: "", 4: None, 5: "​x﻿", 6: "a"}
    assert "regexp" not in trimmed._jdf.queryExecution().optimizedPlan().toString()
    t = features.feature_table(spark.createDataFrame([(1, "walk walked walks walk"), (2, "")], "id int, text string"), suffixes=["ed", "s"])
    assert {r["id"]: (r["stem_ttr"], r["ttr"], r["bigram_diversity"], r["trigram_diversity"]) for r in t.collect()} == {1: (0.25, 0.75, 1.0, 1.0), 2: (0.0, 0.0, 0.0, 0.0)}
    stemmed = t.select("stem_ttr")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in stemmed and "transform(_w#" not in stemmed


def test_only_unstable_texts_are_composed(spark):
    """A character that isn't UNSTABLE is no mark and no later half of a pair, and NFC leaves it as it is."""
    safe = re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{int(m[1], 16):08x}", udf.UNSTABLE.split("&&[^")[1][:-1])
    stable = re.compile(rf"[\U00000000-\U000002ff{safe}")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pairs_ = (unicodedata.decomposition(c).split() for c in points)
    later = {chr(int(d[1], 16)) for d in pairs_ if len(d) == 2 and not d[0].startswith("<")} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    held = [c for c in points if stable.match(c)]
    assert len(held) > 30_000 and not [c for c in held if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or c in later]
    texts = ["plain “text” – é", "e\u0301", "a\u0301 Å", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", udf.composed(F.col("text")).alias("t")).collect()}
    assert got == {k: t and unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}


def test_tokenizers_get_few_texts_at_once():
    """Slices keep the order and hold few characters, whatever the batch."""
    import pandas as pd

    texts = pd.Series(["ab", None, "c" * 9, "", "de", "fgh"])
    got = list(udf.slices(texts, 5))
    assert got == [["ab", ""], ["c" * 9], ["", "de", "fgh"]] and list(udf.slices(texts[:0])) == []


def test_terms_are_counted_where_their_row_is(spark):
    """Counting a row's terms shuffles its text, not its terms; rows that share an id count as one."""
    df = spark.createDataFrame([(1, "a b b"), (1, "b c"), (2, "a c"), (3, None)], "id long, text string")
    got = ml.tfidf(df, "id", "text", ngrams=(1,), min_df=2)
    rows = {(r["id"], r["term"]): r["weight"] for r in got.collect()}
    assert set(rows) == {(1, "a"), (1, "c"), (2, "a"), (2, "c")} and all(abs(w - 0.5**0.5) < 1e-12 for w in rows.values())
    assert not re.search(r"Exchange hashpartitioning\(id#\d+L, term#\d+", got._jdf.queryExecution().executedPlan().toString())


def test_sentences_leave_tasks_in_parts(spark, monkeypatch):
    """Rows are those of the rules, whatever the size of the parts; null and empty texts give none."""
    texts = [None, "", "One sentence stands here. Another one follows it.", "No end at all", *[f"Sentence number {k} is here. " * 3 for k in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for most in (1, 100, udf.SEGMENT_CHARS):
        monkeypatch.setattr(udf, "SEGMENT_CHARS", most)
        got = sorted(map(tuple, udf.segmented(df, "id").collect()))
        assert got == [(k, i, s) for k, t in enumerate(texts) for i, s in enumerate(udf.split_sentences(t))]


def test_markup_round_every_character(spark):
    """Patterns that look first at one character, or for a file's ending, find what they did without that; names of files go."""
    kept = spark.range(0x3100).filter("id < 55296").select(F.udf(chr)("id").alias("k"))
    c = F.concat(*[F.col("k") if x is None else F.lit(x) for x in ("x.pn", None, " a.jpg", None, " q.PNG l", None, "ink= 2 ", None, "right le", None, "t b.webp")])
    plain = c
    for p in tx.MARKUP:
        plain = F.regexp_replace(plain, p.replace("(?=l)", "").replace("(?=[trlfu])", ""), " ")
    assert kept.filter(~tx.strip_markup(c).eqNullSafe(plain)).count() == 0
    assert spark.range(1).select(tx.strip_markup(F.lit("see a.jpg now"))).first()[0] == "see   now"
