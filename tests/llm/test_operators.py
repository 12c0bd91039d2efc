"""Each operator against a brute-force version, on hand-made and small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import decontaminate, exact_dedup, html_extract, language, license_scan, near_dedup, packing, queries, sharding, substring_dedup, token_output
from textloom.llm.common import table

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("id", T.LongType()), T.StructField("key", T.StringType())])


def rnd_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def fixture_rows():
    """Nulls, empties, ties, copies, near copies, a very long text; extra columns have clashing names."""
    rng = random.Random(5)
    texts = [None, "", "", " \n ", "One two", "one two", "a b c d e", "A b c d E", "...", "x" * 300]
    base = rnd_text(rng, 300, 10**6)
    texts += [base] * 5 + [base + " tail end", base.replace("w1", "W1"), base[:600], rnd_text(rng, 20000, 10**5)]
    words = rnd_text(rng, 200, 10**6).split()
    for k in range(30):
        copy = list(words)
        copy[rng.randrange(len(copy))] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [rnd_text(rng, rng.randrange(1, 120), 10**6) for _ in range(40)]
    return [(k, t, ["en", "de", None][k % 3], "d", 1, "k") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(docs, rows, bits):
    got = by_id(exact_dedup.exact_dedup(docs, digest_bits=bits, fan_in=2))
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        g = groups[t or ""]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_min_and_empty(docs, rows, empty):
    assert all(r["keep_id"] <= r["doc_id"] for r in exact_dedup.exact_dedup(docs, keep="min").collect())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(0, 0, 1, False), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_expected(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_dedup(docs, rows, empty):
    got = by_id(near_dedup.near_dedup(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == near_expected(rows)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_chain(spark):
    """A chain of texts, each close to the next only, is one component."""
    rng = random.Random(3)
    words = rnd_text(rng, 150, 10**6).split()
    rows = []
    for k in range(40):
        at = (k * 13) % 150
        words = words[:at] + [f"new{k}"] + words[at + 1 :]
        rows.append((k, " ".join(words)))
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == near_expected(rows)


def test_near_dedup_large_bucket(spark, monkeypatch):
    """Copies edited to different degrees: buckets beyond SMALL go through the blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(11)
    rows = []
    for base in range(3):
        words = rnd_text(rng, 150, 10**6).split()
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randrange(12)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == near_expected(rows)


def test_odd_sketch_tells_similar_from_other():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    close = np.r_[base[:450], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]
    far = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    _, s = near_dedup.signatures([base, close, far])
    ones = lambda a, b: sum(int(x).bit_count() for x in (s[a] ^ s[b]).view("u8"))
    assert ones(0, 0) == 0 and ones(0, 1) < 80 < 110 < ones(0, 2)


def contaminated(docs, items):
    split = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + min(13, len(w))]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= who
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontaminate(spark, empty):
    rng = random.Random(9)
    items = [(k, rnd_text(rng, n, 50)) for k, n in enumerate([40, 13, 14, 25, 60, 5, 12, 1])] + [(20, None), (21, "..."), (22, ""), (2, "w1x w2x")]
    items += [(30, items[0][1]), (31, "Ärger über Öl " * 6)]
    docs = []
    for k in range(60):
        _, item = rng.choice(items[:8])
        w = item.split()
        a = rng.randrange(len(w))
        docs.append((k, f"{rnd_text(rng, rng.randrange(0, 200), 60)}. {' '.join(w[a : a + rng.randrange(1, 40)]).upper()}, {rnd_text(rng, 20)}"))
    docs += [(100, None), (101, ""), (102, "!!"), (103, items[0][1] * 40), (104, "ärger Über öl " * 6), (105, "ÄRGER über öl " * 6)]
    want = contaminated(docs, items)
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, words string, item int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    clean = decontaminate.decontaminate(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["n_hit"] for r in clean)


def check_shards(rows, out, shards=24):
    got = out.collect()
    size = {i: len((t or "").encode()) + 8 for i, t, *_ in rows}
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size[r["doc_id"]], crc[r["doc_id"]], "bytes", None) for r in got)
    sums = {}
    for r in got:
        sums.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in sums.values())
    total, most = sum(size.values()), max(size.values())
    share = [sum(r["size"] for r in sums.get(k, [])) for k in range(shards)]
    assert max(share) <= total / shards * (1 + 2 * sharding.WHOLE) + 2 * most
    return got


def test_sharding(spark, docs, rows, empty):
    check_shards(rows, sharding.shard_rows(docs, shards=6), 6)
    assert sharding.shard_rows(empty).count() == 0


def test_sharding_hot_text(spark):
    """A third of the rows are one text: it is subdivided, smaller groups are not."""
    rng = random.Random(2)
    rows = [(k, "hot " * 50 if k % 3 == 0 else f"copy {k // 15} " + "y" * 100 if k % 3 == 1 else rnd_text(rng, 30)) for k in range(3000)]
    got = check_shards(rows, sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")))
    text, of = dict(rows), {}
    for r in got:
        of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(of["hot " * 50]) > 6 and all(len(s) == 1 for t, s in of.items() if t.startswith("copy"))


@pytest.mark.parametrize("rows_per_range", [4, 50, 1_000_000])
def test_sharding_keeps_groups_whole_whatever_the_number_of_ranges(spark, rows_per_range):
    """Groups of up to 12 rows, 1 % of a shard each, beside one text with a fifth of the rows."""
    rng = random.Random(9)
    rows = [(k, f"group {k // 12} " + "z" * 20 if k % 5 else "hot " * 25) for k in range(3000)]
    rows += [(4000 + k, rnd_text(rng, 20)) for k in range(300)]
    got = check_shards(rows, sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=6, rows_per_range=rows_per_range), 6)
    text, of = dict(rows), {}
    for r in got:
        of.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(of["hot " * 25]) > 2 and all(len(s) == 1 for t, s in of.items() if t != "hot " * 25)


def repeats(rows, length):
    seen = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring_dedup(spark, docs, rows, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == repeats(rows, 200)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_borders(spark):
    """Passages of lengths around the threshold in different surroundings; runs; accents."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    passages = [letters(n) for n in (170, 195, 198, 199, 200, 201, 260, 400)]
    rows = [(k, letters(rng.randrange(300)) + passages[k % 8][: rng.randrange(190, 420)] + letters(rng.randrange(200)) + passages[rng.randrange(8)]) for k in range(60)]
    rows += [(100, "ab" * 300), (101, "a" * 199), (102, "a" * 200), (103, "b" * 201), (104, letters(150) * 3)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeats(rows, 200)


def test_substring_dedup_in_pieces_and_without_ids(spark, monkeypatch):
    """Long texts go through in pieces; rows without an id count like others."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 1 << 10)
    monkeypatch.setattr(substring_dedup, "PLACE", 10)
    rng = random.Random(12)
    shared = rnd_text(rng, 900, 10**6)
    texts = [rnd_text(rng, 700, 10**6) + shared[a:] for a in (0, 100, 3000)] + [shared[50:900], rnd_text(rng, 300, 10**6), shared[:500], shared[:500], None]
    rows = [(k if k != 3 and k < 5 else None, t) for k, t in enumerate(texts)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = repeats(list(enumerate(texts)), 200)
    assert got == sorted((str(rows[k][0]), *x) for k, x in want.items())


def test_pieces_cover_a_text(monkeypatch):
    """Small pieces: every window once, in order, and equal windows have their anchor at the same place."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 1 << 10)
    monkeypatch.setattr(substring_dedup, "PLACE", 10)
    data = substring_dedup.raw(rnd_text(random.Random(1), 900, 60))
    n, anchor = 0, {}
    for base, prefix, at, first, last in substring_dedup.pieces(data, 200):
        assert base + first[0] == n and (first[1:] == last[:-1] + 1).all() and len(prefix) <= (1 << 10) + 1
        n = base + last[-1] + 1
        for a, x, y in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
            for s in range(x, y + 1):
                assert anchor.setdefault(bytes(data[base + s : base + s + 200]), a - s) == a - s
    assert n == len(data) - 199
    ks = np.array([3, 0, 20, 7])
    got = sorted((int(k), int(base + f)) for base, _, first, _, mine in substring_dedup.chosen(data, ks, 200) for f, k in zip(first, ks[mine], strict=True))
    every = [base + f for base, _, _, first, _ in substring_dedup.pieces(data, 200) for f in first.tolist()]
    assert got == sorted((int(k), every[k]) for k in ks)


def test_prefix_doubling_finds_the_same(spark, docs, rows):
    """The dealt method, which is too large for the check's limits, against brute force."""
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs.filter("length(text) < 50000 OR text IS NULL"), doubling=True).collect()}
    assert got == repeats([r for r in rows if len(r[1] or "") < 50000], 200)


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(queries.tokenizer())
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["<|endoftext|> Hi", "A\x1cb  c\td e", "it's DON'T,, x.", "İstanbul ΣΑΣ", "é Éa. ́x", "a\r\nb", "x,'s y.'t", "日本語 text", "don't. Don't."]


def test_memo_encoder_equals_the_library():
    from textloom.llm.tokens import Encoder

    texts = ODD + [t for _, t, *_ in fixture_rows()]
    enc = Encoder(queries.tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in enc.encode([t or "" for t in texts])] == ids_of(texts)


def test_packing(spark, rows, empty):
    rows = [(k, t) for k, t in enumerate([t for _, t, *_ in rows] + ODD)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), queries.tokenizer(), capacity=256, group_rows=3, slack=4).collect()
    want = set()
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want |= {(i, k, at, len(p := ids[at : at + 256]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 256))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert len(seqs) <= 1.05 * -(-sum(w[3] for w in want) // 256) + 1
    assert packing.pack_documents(empty, queries.tokenizer()).count() == 0


def test_packing_goes_on_with_many_bins(spark):
    """More underfull bins than a group may hold still meet, in later rounds."""
    words = "one two three four five six seven eight nine ten".split()
    df = spark.createDataFrame([(k, " ".join(words[k % 10 :] + words * 2)) for k in range(48)], "doc_id long, text string").repartition(48, "doc_id")
    for group_rows in (3, 250_000):
        got = packing.pack_documents(df, queries.tokenizer(), capacity=256, group_rows=group_rows, slack=4).collect()
        fills = {}
        for r in got:
            fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
        assert len(got) == 48 and max(fills.values()) <= 256
        assert len(fills) <= -(-sum(fills.values()) // 256) + 2


def test_best_fit():
    lengths = np.array([5, 5, 4, 3, 3, 0, 10], np.int64)
    bins, offsets = packing.best_fit(lengths, 10)
    assert len(set(bins.tolist()) - {bins[5]}) == 3
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths.tolist(), bins.tolist(), strict=True) if x == b and n)
        assert all(o + n == p for (o, n), (p, _) in zip(own, own[1:], strict=False))


def test_token_output(spark, rows, empty):
    rows = [(k * 7 % 101, t) for k, t in enumerate([t for _, t, *_ in rows] + ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.round_trip(df, queries.tokenizer(), parts=3).collect()}
    at, want = 0, {}
    order = sorted(rows, key=lambda r: r[0])
    for (i, _), ids in zip(order, ids_of([t for _, t in order]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want
    assert token_output.round_trip(empty, queries.tokenizer()).count() == 0


@pytest.mark.parametrize("max_bits", [4, 9, 16])
def test_huffman(max_bits):
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.3, 5000), 12) * 3
    counts = np.bincount(ids)
    lengths = token_output.code_lengths(counts, max_bits)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= max_bits and abs((2.0**-used).sum() - 1) < 1e-12 and ((lengths > 0) == (counts > 0)).all()
    bits, checkpoints = token_output.encode_block(ids, token_output.codes(lengths), lengths)
    assert (token_output.decode_block(bits, checkpoints, len(ids), token_output.decode_table(lengths)) == ids).all()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="post">
<header><p>Site name</p></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div class="content-12"><article><h1>A &amp; B</h1><p>First <b>bold<i>words</i></b>
 &nbsp; end<br>more<p>Second &lt;tag&gt; a < b<div class="ad">Buy</div><ul><li>one<li>two</ul><form><p>mail</p></form></article></div>
<div class="sidebar"><p>Side text that is long enough to count as text</p></div><section id="comments"><p>Reader says</p></section><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.replace("First", f"First{k}")) for k in range(5)] + [(10, None, PAGE), (11, "http://b.example/", None), (12, "bad url", ""), (13, "http://c.example/x", "plain &eacute; text"), (14, "http://a.example/9", "<p>Only this")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    for bound in (50_000, 0):
        got = {r["page_id"]: r for r in html_extract.extract_pages(df, broadcast_hosts=bound).collect()}
        assert got[3]["text"] == "A & B\n\nFirst3 boldwords end more\n\nSecond <tag> a < b\n\none\n\ntwo"
        assert got[10]["text"].startswith("A & B\n\nFirst bold") and got[11]["text"] == got[12]["text"] == ""
        assert got[13]["text"] == "plain é text" and got[14]["text"] == "Only this"
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', ["one two", "three"]),
        ("<p>one <math/> two</p><p>three <svg><path d='M0'/><text>no</text></svg> four</p>", ["one two", "three four"]),
        ('<p>one <svg class="i"><use href="#a"/></svg> two</p><p>three</p>', ["one two", "three"]),
        ("<p>one <svg><path d='M0'> </p><p>three</p><p>four <svg><g/></svg></p>", ["one", "three", "four"]),
        ("<div>one <svg><g>no</div><p>three</p>", ["one", "three"]),
        ("<p>one <svg><title/><style/><![CDATA[ <p>no ]]><g/></svg> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <svg><svg/><g>no</g><foreignObject><div><p>no</p></div></foreignObject></svg> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <button>no <div>no</div> no</button> two</p><p>three</p>", ["one two", "three"]),
        ("<div><p>one</p><button>no</div><p>two</p><button>no</button><p>three</p>", ["one", "two", "three"]),
        ("<p>one</p><canvas><p>no</p></canvas><div><canvas>no</div><p>two</p>", ["one", "two"]),
        ("<p>one</p><script src=x/>no</script><p>two</p><textarea>no", ["one", "two"]),
    ],
)
def test_html_inert_elements(inner, want):
    """Icons, formulas and buttons leave out what is in them and nothing behind them."""
    assert html_extract.extract(f"<body><article>{inner}</article></body>", []).split("\n\n") == want


def test_html_takes_the_whole_article(spark):
    """A container that holds most of the text brings the rest of its article with it."""
    long = [f"Paragraph {k} " + "of the long text " * 40 for k in range(4)]
    inner = '<div class="entry-content">' + "".join(f"<p>{p}</p>" for p in long) + "</div>"
    links = "<p><a href=x>An older story with a long headline</a></p>"
    texts = [p.strip() for p in long]
    head, body = "<h1>Title</h1><p class=lead>The lead</p>", f"{inner}<section><p>Sources</p></section>"
    shapes = {
        f"<article>{head}{body}{links}</article><div><p>Elsewhere</p></div>": ["Title", "The lead", *texts, "Sources", "An older story with a long headline"],
        f"<main>{head}{body}<div>{links}</div></main><p>Elsewhere</p>": ["Title", "The lead", *texts, "Sources"],
        f'<div class="post">{head}<div class="text">{inner}</div>{links}</div><div><p>Elsewhere</p></div>': ["Title", "The lead", *texts],
        f"<main><article>{head}{inner}</article><section><p>Elsewhere</p></section></main>": ["Title", "The lead", *texts],
        f"<div>{inner}</div><div><p>Elsewhere</p></div>": texts,
    }
    for shape, want in shapes.items():
        assert html_extract.extract(f"<body>{shape}</body>", []).split("\n\n") == want, shape[:40]
    short = "<body><article><h1>Short</h1><p class=lead>Its lead</p><div class='entry-content'><p>Few words</p></div></article></body>"
    pages = [(k, f"http://a.example/{k}", f"<body>{next(iter(shapes))}</body>") for k in range(4)] + [(9, "http://a.example/9", short)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0].startswith("Title\n\nThe lead\n\nParagraph 0") and got[9] == "Short\n\nIts lead\n\nFew words"


def test_html_on_the_table(spark, sf_dir):
    """The pages' articles by a plain cut of their known layout."""
    import html

    want = {}
    for r in table(spark, sf_dir, "pages").collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = "\n\n".join(b for x in re.split("</?(?:p|h1)>", body) if (b := " ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split())))
    assert {r["page_id"]: r["text"] for r in queries.op1_html_extraction(spark, sf_dir).collect()} == want


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    rows = [(1, f"Hello.\n\n{mit}, subject to the following.\n\nBye."), (2, "Released under the MIT License.\nx y"), (3, "no such word"), (4, None), (5, ""), (6, "My driving license is old."), (7, "Licensed under the Apache License, Version 2.0."), (8, "the GNU Lesser General Public License, version 3")]
    got = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {1: {"MIT"}, 2: {"MIT"}, 6: {None}, 7: {"Apache-2.0"}, 8: {"LGPL-3.0"}}


def test_license_scan_long_lines():
    """A notice in the middle of a long line is found whatever rank compression gives its template."""
    rng = random.Random(6)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    plain = "the of and to in software version rights work terms public general under use copy person any subject time free".split()
    for name, wordings in license_scan.TEMPLATES.items():
        for wording in wordings:
            for n in (30, 300, 3000):
                around = [rng.choice(plain) if rng.random() < 0.3 else f"w{rng.randrange(10**4)}" for _ in range(n)]
                block = f"{' '.join(around[: n // 2])}. {wording}. {' '.join(around[n // 2 :])}"
                assert name in str(scanner.judge(block)), (wording, n)


def test_license_scan_several_in_a_line(spark):
    """Each licence of a block has its row; wordings over the same words give one."""
    t = license_scan.TEMPLATES
    gpl2, gpl3 = t["GPL-2.0"][1], t["GPL-3.0"][1]
    texts = [
        ("Licensed under the Apache License, Version 2.0 or the MIT License.", {"Apache-2.0", "MIT"}),
        (f"{t['MIT'][1]}. All rights reserved.", {"MIT", "ALL-RIGHTS"}),
        (" ".join(w for ws in t.values() for w in ws), set(t)),
        (f"{gpl2}. We have 3 of the license texts.", {"GPL-2.0"}),
        (f"{gpl3}. And {gpl2}.", {"GPL-2.0", "GPL-3.0"}),
        ("the MIT License, again the MIT License", {"MIT"}),
        ("My driving license is old.", {None}),
    ]
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(texts)], "doc_id long, text string")
    got = [(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, name) for k, (_, names) in enumerate(texts) for name in names}
    inner = license_scan.scan_licenses(df.filter("doc_id = 0"), templates={"A": ["Apache License, Version 2.0 or the MIT License"], "M": ["the MIT License"]}).collect()
    assert [r["license"] for r in inner] == ["A"]


def test_word_distances_equal_the_table_of_edits():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(least, 12))] for least in (1, 0))
        got, column = [], list(range(len(a) + 1))
        for y in b:
            last, column = column, [0]
            for k, x in enumerate(a):
                column.append(min(last[k] + (x != y), last[k + 1] + 1, column[k] + 1))
            got.append(column[-1])
        assert [*license_scan.distances(a, b)] == got


def test_license_scan_tells_places_and_differences(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    changed = mit.replace("free of charge", "free of any charge").replace("hereby ", "").replace("merge", "fuse")
    around = " ".join(f"w{k}" for k in range(10_000))
    texts = [f"Intro.\n\n{around} {changed} {around}", "x. the MIT License y the MIT License", "the MIT License", "my licence", "", None]
    df = spark.createDataFrame([(k, t, 1, "a", "b") for k, t in enumerate(texts)], "doc_id long, text string, start int, license string, at string")
    got = license_scan.scan_licenses(df).collect()
    first = [r for r in got if r["doc_id"] == 0]
    assert {(r["license"], r["n_missing"], r["missing"], r["extra"], r["n_places"]) for r in first} == {("MIT", 2, "hereby merge", "any fuse", 1)}
    assert all(texts[0][r["at"] : r["at"] + r["at_length"]] == changed.rstrip(".") for r in first)
    assert {(r["doc_id"], r["license"], r["at"], r["at_length"], r["n_places"]) for r in got if r["doc_id"]} == {(1, "MIT", 3, 15, 2), (2, "MIT", 0, 15, 1), (3, None, 0, 0, 0)}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def brute_licenses(text):
    """Licences whose name stands in a line word for word, or whose notice some run of its words equals but for a tenth."""
    out = set()
    for line in text.split("\n"):
        own = license_scan.words(line)
        for name, wordings in license_scan.known_wordings().items():
            for ws in map(license_scan.words, wordings):
                allowed = int(license_scan.DIFFER * len(ws)) if len(ws) > license_scan.NAME else 0
                if len(set(ws) - set(own)) > allowed:
                    continue
                if not allowed:  # a name: word for word, and not denied
                    at = [k for k in range(len(own)) if own[k : k + len(ws)] == ws]
                    if any(license_scan.DENIALS.isdisjoint(own[max(0, k - license_scan.DENIED) : k]) for k in at):
                        out.add(name)
                    continue
                column = list(range(len(ws) + 1))
                for y in own:
                    last, column = column, [0]
                    for k, x in enumerate(ws):
                        column.append(min(last[k] + (x != y), last[k + 1] + 1, column[k] + 1))
                    if column[-1] <= allowed:
                        out.add(name)
                        break
    return out


def test_license_scan_equals_word_alignment(spark, sf_dir):
    """Licences found line by line in the whole table; every other line has no trigger or no wording."""
    got = {}
    for r in license_scan.scan_licenses(table(spark, sf_dir, "documents")).collect():
        if r["license"]:
            got.setdefault(r["doc_id"], set()).add(r["license"])
    trigger = re.compile(license_scan.TRIGGER)
    want = {d["doc_id"]: found for d in table(spark, sf_dir, "documents").collect() if (found := brute_licenses("\n".join(x for x in (d["text"] or "").split("\n") if trigger.search(x))))}
    assert got == want and want


def test_license_scan_equals_plain_search(spark, sf_dir):
    """Every name template that stands in a line is found there."""
    docs = table(spark, sf_dir, "documents").collect()
    got = {}
    for r in license_scan.scan_licenses(table(spark, sf_dir, "documents")).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    for name, phrase in (("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("GPL-3.0", "GNU General Public License, version 3")):
        assert {d["doc_id"] for d in docs if phrase in d["text"]} == {i for i, s in got.items() if name in s}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    score, counts, move = rng.normal(size=(70 + 3 + 40, 3)), np.array([70, 0, 3, 40]), rng.normal(size=(3, 3))
    got, at = language.marginals(score, counts, move), 0
    for n in counts:
        if n:
            ahead = [np.exp(score[at]) * (np.ones(3) / 3 @ np.exp(move))]
            for k in range(1, n):
                ahead.append((ahead[-1] @ np.exp(move)) * np.exp(score[at + k]))
                ahead[-1] /= ahead[-1].sum()
            back = [np.ones(3)]
            for k in range(n - 1, 0, -1):
                back.append(np.exp(move) @ (np.exp(score[at + k]) * back[-1]))
                back[-1] /= back[-1].sum()
            want = np.array(ahead) * np.array(back[::-1])
            assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True), atol=1e-4)
        at += n


def test_language(spark, sf_dir, docs, rows, empty):
    known = {r["doc_id"]: r["lang"] for r in table(spark, sf_dir, "documents").collect()}
    got = by_id(queries.op10_language_id(spark, sf_dir))
    assert set(got) == set(known) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == known[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = by_id(language.identify(docs))
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (0, 1, 2, 3, 8))
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_switching_is_seen():
    de = [f"der die und nicht über schön {w}ung {w}keit" for w in ("bild", "ordn", "wirk", "stell", "heiz", "reg")] * 12
    en = [f"the and with of shaking {w}ing {w}tion" for w in ("reason", "sta", "mo", "na", "ra", "lo")] * 12
    model = language.fit(de + en, ["de"] * len(de) + ["en"] * len(en))
    words = language.Words([" ".join(de[:8] + en[:8])])
    belief = language.marginals(words.emissions(model["weights"])[words.word], words.counts, model["transition"])
    first = [n.argmax() for n in belief[: len(" ".join(de[:8]).split())]]
    rest = [n.argmax() for n in belief[len(" ".join(de[:8]).split()) :]]
    assert np.mean(first) < 0.1 and np.mean(rest) > 0.9


def test_null_ids_and_repeated_rows(spark):
    """Null ids, null texts and repeated rows crash nothing, and no row is lost."""
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(None, long), (None, None), (None, long), (7, long), (7, long), (8, None), (8, None), (9, "short text"), (1 << 40, long + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(None, long), (1, None), (2, long)], "item_id long, text string")
    runs = {
        "exact": exact_dedup.exact_dedup(df), "near": near_dedup.near_dedup(df), "shards": sharding.shard_rows(df, shards=3), "repeats": substring_dedup.remove_repeats(df),
        "tokens": token_output.round_trip(df, queries.tokenizer()), "clean": decontaminate.decontaminate(df, bench), "packed": packing.pack_documents(df, queries.tokenizer()),
        "language": language.identify(df.withColumn("lang", F.lit("en"))),
    }
    for name, out in runs.items():
        got = out.collect()
        assert len(got) == len(rows), name
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows), name
    near = {(r["doc_id"], r["component_id"], r["kept"]) for r in runs["near"].collect()}
    assert near == {(None, None, False), (7, 7, True), (8, 8, True), (9, 9, True), (1 << 40, 7, False)}
    pages = spark.createDataFrame([(None, None, None), (1, "http://h/x", "<p>a"), (1, "http://h/x", "<p>a"), (None, "http://h/x", "<p>b")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_extract.extract_pages(pages).collect()) == [(0, ""), (0, "b"), (1, "a"), (1, "a")]
    notices = spark.createDataFrame([(None, "Released under the MIT License."), (None, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(notices).collect()] == [(None, "MIT")]
