"""Lattice likelihoods against sums over all segmentations, and the whole operator against a plain version."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from textloom.llm import lattice_lm

VOCABULARY = [(b" ", 0.5), (b" a", 0.4), (b"ab", 0.2), (b" ab", 0.1), (b"b", 0.3), (b"ba", 0.2), (b" the", 0.3), (b"he", 0.1), (b"t", 0.1), ("é".encode(), 0.2), ("日本".encode(), 0.1), (b"xxxxxxxx", 0.05)]


def segmentations(s, pieces):
    if not s:
        yield ()
    for n in range(1, len(s) + 1):
        if s[:n] in pieces:
            yield from ((s[:n], *more) for more in segmentations(s[n:], pieces))


@pytest.mark.parametrize("cells", [8, 1 << 16])
def test_all_segmentations(cells, monkeypatch):
    monkeypatch.setattr(lattice_lm, "CELLS", cells)
    lattice = lattice_lm.Lattice(VOCABULARY)
    p = dict(zip(lattice.pieces, np.exp(lattice.log), strict=True))
    assert abs(sum(p.values()) - 1) < 1e-9 and len(p) == 251 + 9
    words = [b"ab", b"abab", b"the", b"bathe", "é日本é".encode(), b"\x00a", b"zz", b"x" * 9, b"a"]
    counts = np.arange(1.0, len(words) + 1)
    got, want = np.zeros(len(p)), Counter()
    for which, data, lengths in lattice_lm.lattices(words):
        alpha = lattice.forward(data)
        got += lattice.expected(data, lengths, counts[which])
        for k, w in enumerate(which.tolist()):
            ways = [(math.prod(p[x] for x in s), s) for s in segmentations(b" " + words[w], p)]
            total = sum(q for q, _ in ways)
            assert math.isclose(alpha[k, lengths[k]], math.log(total))
            for q, s in ways:
                for x in s:
                    want[x] += counts[w] * q / total
    assert np.allclose(got, [want[x] for x in lattice.pieces])


def test_long_word(monkeypatch):
    monkeypatch.setattr(lattice_lm, "CELLS", 100)
    lattice = lattice_lm.Lattice(VOCABULARY)
    word = b"abthe" * 400
    ((_, data, lengths),) = lattice_lm.lattices([word])
    alpha = [0.0]
    p = dict(zip(lattice.pieces, lattice.log, strict=True))
    s = b" " + word
    for t in range(1, len(s) + 1):
        ways = [alpha[t - n] + p[s[t - n : t]] for n in range(1, min(t, 8) + 1) if s[t - n : t] in p]
        alpha.append(max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways)))
    assert np.allclose(lattice.forward(data)[0], alpha)
    uses = lattice.expected(data, lengths, np.ones(1))
    assert math.isclose(sum(u * len(x) for u, x in zip(uses, lattice.pieces, strict=True)), len(s))  # every byte is under one piece


def expected(rows, rounds):
    """Word marginals by segmentation sums over a plain dictionary of pieces."""
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    train = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    all_, distinct, ends = sum(train.values()), len(train), train[None]
    lattice = lattice_lm.Lattice(VOCABULARY)
    p = dict(zip(lattice.pieces, np.exp(lattice.log), strict=True))
    end = 0.0

    def chain(s):
        a, b = [1.0], [1.0]
        for t in range(1, len(s) + 1):
            a.append(sum(a[t - n] * p[s[t - n : t]] for n in range(1, min(t, 8) + 1) if s[t - n : t] in p))
            back = s[len(s) - t :]
            b.append(sum(b[t - n] * p[back[:n]] for n in range(1, min(t, 8) + 1) if back[:n] in p))
        return a, b[::-1]

    for _ in range(rounds):
        uses = Counter()
        for w, c in train.items():
            if w is not None:
                s = b" " + w
                a, b = chain(s)
                for t in range(1, len(s) + 1):
                    for n in range(1, min(t, 8) + 1):
                        if (x := s[t - n : t]) in p:
                            uses[x] += c * a[t - n] * p[x] * b[t] / a[-1]
        total = sum(uses.values()) + ends + 0.1 * (len(p) + 1)
        p, end = {x: (uses[x] + 0.1) / total for x in p}, (ends + 0.1) / total
    out = []
    for i, t in rows:
        toks = [*words(t), None]
        base = sum(math.log10((train[w] + 0.1) / (all_ + 0.1 * (distinct + 1))) for w in toks)
        score = sum(math.log10(chain(b" " + w)[0][-1]) for w in toks[:-1]) + math.log10(end)
        out.append((i, held(i), len(toks), sum(train[w] > 0 for w in toks), all_, base, score))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_score_texts(spark, monkeypatch, head):
    for name, value in {"HEAD": head, "LONGEST": 12, "HELD": 20, "PART": 200}.items():
        monkeypatch.setattr(lattice_lm, name, value)
    rng = random.Random(6)
    text = lambda n: rng.choice([" ", "\n", "\t"]).join(rng.choice(["the", "THE", "bab", "é日本", "ab▁ab", "x" * 20, "q"]) + rng.choice(["", "a", str(rng.randrange(30))]) for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \n\x0b "), (None, "the the"), (4, "İ ab b"), (5, text(3000))] + [(6 + k, text(rng.randrange(1, 30))) for k in range(90)]
    rows += [(200 + k, "the same") for k in range(50)] + [rows[20]] * 3 + [(rows[20][0], "another")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, score int").repartition(6)
    got = lattice_lm.score_texts(df, VOCABULARY)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, want = order(map(tuple, got.collect())), order(expected(rows, lattice_lm.ROUNDS))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_nothing_to_learn(spark):
    assert lattice_lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
    r = lattice_lm.score_texts(spark.createDataFrame([(None, "ab the")], "doc_id long, text string"), VOCABULARY).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 3, 0, 0, 0.0) and r["score"] < 0


def test_fit_helps_held_out_texts(spark, sf_dir):
    """Fitted pieces give held-out texts a higher likelihood than the vocabulary's own scores, and beat bytes by far."""
    import public_tokenizers

    vocabulary = lattice_lm.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 100")
    sums = [lattice_lm.score_texts(docs, v, rounds=n).filter("held_out").agg({"score": "sum"}).first()[0] for v, n in ((vocabulary, 0), (vocabulary, 1), (vocabulary, 3), ([], 1))]
    assert sums[0] < sums[1] < sums[2] and sums[3] < sums[2]
