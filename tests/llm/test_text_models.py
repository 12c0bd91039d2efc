"""Token ids against the library, near-duplicates against all pairs, and the language model's gradients."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from test_operators import by_id, near_expected

from textloom.llm import language, near_dedup, packing, queries
from textloom.llm.common import table
from textloom.llm.tokens import Encoder


def odd_texts():
    rng = random.Random(21)
    alphabet = [*"aAzZ019 \n\t,.'<|>-", "é", "É", "ß", "İ", "ı", "Σ", "ς", "́", "ͅ", "ǅ", "ﬁ", "Å", "한", "语", "٣", "½", "​", " ", " ", "\x85", "😀", "\x1c", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(30)) for _ in range(300)]
    texts += [f"a {s} b{s}c" for s in ("<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|endoftext|", "<|end oftext|>")]
    return [*texts, "x" * 200_000, "Ab" * 5_000 + ".", "", " ", "don't DON'T they'LL 'S"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(name):
    from tokenizers import Tokenizer

    texts = odd_texts()
    want = [x.ids for x in Tokenizer.from_str(queries.tokenizer(name)).encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(queries.tokenizer(name))
    assert enc.by_words == name.startswith("word")
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(texts)] == want


def test_ids_of_the_table(sf_dir):
    import duckdb
    from tokenizers import Tokenizer

    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    want = [x.ids for x in Tokenizer.from_str(queries.tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(queries.tokenizer()).encode(texts)] == want


def test_packing_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two", 5, 6, "x"), (2, None, 5, 6, "y")], "doc_id long, text string, bin int, length int, piece string")
    got = {(r["doc_id"], r["length"]) for r in packing.pack_documents(df, queries.tokenizer()).collect()}
    assert got == {(1, 3), (2, 1)}


def thue_morse(flip):
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024))


def test_structured_words_stay_apart(spark):
    rows = [(1, thue_morse(0)), (2, thue_morse(1)), (3, "A b  c\td e"), (4, "a b c d e f"), (5, "e d c b a"), (6, "a b c d e")]
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == near_expected(rows)
    assert len({next(near_dedup.shingle_hashes([t])).tobytes() for _, t in rows}) == 5


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 50)
    rng = random.Random(3)
    for text in ("x" * 400 + " y", " ".join("w" * rng.randrange(1, 90) for _ in range(60)), "\n \n" * 80, "é " * 200):
        words = text.encode().lower().split()
        assert near_dedup.word_names(text).tolist() == [int.from_bytes(hashlib.blake2b(w, digest_size=8, key=near_dedup.KEY).digest(), "little") for w in words]


def test_near_dedup_finds_every_link_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = by_id(near_dedup.near_dedup(docs))
    want = near_expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == want


def loss(score, label, counts, transition):
    """Minus the log-likelihood of the labels, by sums over all states."""
    total, at, n = 0.0, 0, len(transition)
    for size in counts:
        if not size:
            continue
        log = np.logaddexp.reduce(transition, 0) - np.log(n)
        own = log[label[at]] + score[at, label[at]]
        state = log + score[at]
        for k in range(at + 1, at + size):
            state = np.logaddexp.reduce(state[:, None] + transition, 0) + score[k]
            own += transition[label[k - 1], label[k]] + score[k, label[k]]
        total += np.logaddexp.reduce(state) - own
        at += size
    return total


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(5)
    counts = np.array([70, 0, 1, 5, 40])
    score, move, label = rng.normal(size=(116, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, 116)
    by_place, by_move = language.gradients(score, label, counts, move)
    step = 1e-4
    for i in range(3):
        for j in range(3):
            d = np.zeros((3, 3))
            d[i, j] = step
            assert abs((loss(score, label, counts, move + d) - loss(score, label, counts, move - d)) / (2 * step) - by_move[i, j]) < 1e-2
    for k in (0, 31, 32, 69, 70, 71, 75, 115):
        for j in range(3):
            d = np.zeros_like(score)
            d[k, j] = step
            assert abs((loss(score + d, label, counts, move) - loss(score - d, label, counts, move)) / (2 * step) - by_place[k, j]) < 1e-3


def test_letters_are_unicode_s(spark):
    rows = [(1, "der und nicht", "de"), (3, "the and with", "en"), (4, "½ ²", None), (5, "Ⅷ ①", None), (6, "_ 12", None), (7, "语", None), (8, "“the” — and…", None)]
    got = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {4, 5, 6}
    assert len(language.Words(["“the” — and… l’eau"]).counts) == 1 and language.Words(["“the” — and… l’eau"]).counts[0] == 4
    carried = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), carry=True)
    assert carried.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {(r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in carried.collect()} == {(i, t, got[i]["lang_pred"], got[i]["score"]) for i, t, _ in rows}
