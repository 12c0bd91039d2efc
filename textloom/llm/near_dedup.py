"""Near-duplicate components by MinHash bands, odd sketches and exact checks.

Words are named by keyed 64-bit digests (BLAKE2b) and shingles by mixing five of
them in order. Texts with the same shingle set are one class, handled by its
smallest id. Each
class has SAMPLES MinHash values. They key its bands, and, folded into a parity
bitmap, are its odd sketch: the XOR of two sketches has about
bits/2 * (1 - exp(-4 * differing / bits)) ones, which tells high similarities
well from lower ones before any text is read. Pairs that pass are confirmed on
their full shingle sets.

A bucket's pairs are never all made. Its members are paired with one member;
links merge components. What is then undecided are members of different
components in one bucket. In buckets of up to SMALL members they are joined
under the sketch's condition. In larger ones the members outside the bucket's
commonest component meet all members in blocks: each block compares sketches
first, asks for the texts of those that these allow a link, checks their full
sets, and gives at most one link for each two components that it joins. No
candidate is lost either way. Rows of a hot bucket are dealt over salts wherever
buckets are joined.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bit_filter, forget, give_back, materialise, might_contain, mix, repeated_ids, row_hash, spread_join
from textloom.llm.components import components

ROWS, BANDS = 4, 30
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
#: Pairs whose sketches suggest a similarity below this go unchecked: over four deviations under 0.75.
SKETCH_FLOOR = 0.5
SMALL, BLOCK = 64, 1024
#: Rows of a bucket that one task gets in a join; more are dealt over several.
HOT = 256
_rng = np.random.default_rng(4711)
FLIP = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
TURN = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEY = b"textloom shingle words"
#: Words that a worker remembers, and the bytes of the longest: 50 MB at the worst.
MEMO, LONGEST = 200_000, 48
#: Bytes of a text that are split into words at once.
PART = 1 << 22
GAP = re.compile(rb"[\x20\x09-\x0D]")


class WordNames(dict[bytes, int]):
    """Keyed 64-bit digest of each word, with a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        name = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little")
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = name
        return name


names = WordNames()


def word_names(text: str | None) -> np.ndarray:
    """Names of a text's words in order; bytes.lower() and bytes.split() know A-Z and the six ASCII spaces only."""
    raw = (text or "").encode("utf-8", "replace").lower()
    parts, at = [], 0
    while at < len(raw) or not parts:
        gap = GAP.search(raw, at + PART) if len(raw) - at > PART else None
        end = gap.start() if gap else len(raw)
        words = raw[at:end].split()
        parts.append(np.fromiter(map(names.__getitem__, words), np.uint64, len(words)))
        at = end + 1
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_hashes(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty for no words."""
    words = [word_names(t) for t in texts]
    flat = np.concatenate([np.zeros(0, np.uint64), *words])
    n = len(flat) - width + 1
    every = mix(np.full(max(n, 0), width, np.uint64))
    for k in range(width):
        every = mix(every + flat[k : n + k]) if n > 0 else every
    at = 0
    for w in words:
        if len(w) >= width:
            yield np.unique(every[at : at + len(w) - width + 1])
        elif len(w):
            few = mix(np.full(1, len(w), np.uint64))
            for k in range(len(w)):
                few = mix(few + w[k : k + 1])
            yield few
        else:
            yield np.zeros(0, np.uint64)
        at += len(w)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(MinHash values, odd sketches as 64-bit words) of non-empty sets."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0, *map(len, sets[:-1])])
    values = np.stack([np.minimum.reduceat((flat ^ f) * t, heads) for f, t in zip(FLIP, TURN, strict=True)], 1)
    slot = (mix(values + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    cells = np.bincount((slot + np.arange(len(sets))[:, None] * SKETCH_BITS).ravel(), minlength=len(sets) * SKETCH_BITS)
    sketches = np.packbits((cells & 1).astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1).view("<i8")
    return values, sketches


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (shingles), cls (digest of the set), sketch, bands; without shingles only id and n."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from textloom.llm.tokens import batches

        for frame in frames:
            ids, at = frame["id"].tolist(), 0
            for texts in batches(frame["text"].tolist(), 1_000_000):
                sets = list(shingle_hashes(texts))
                some = [s for s in sets if len(s)]
                rows = iter(())
                if some:
                    values, sketches = signatures(some)
                    bands = np.zeros((len(some), BANDS), np.uint64)
                    for r in range(ROWS):
                        bands = mix(bands + values[:, r::ROWS] * np.uint64(2 * r + 3))
                    bands = mix(bands + np.arange(BANDS, dtype=np.uint64)).view("<i8")
                    rows = zip((hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in some), sketches.tolist(), bands.tolist(), strict=True)
                out = [(i, len(s), *(next(rows) if len(s) else (None, None, None))) for i, s in zip(ids[at : at + len(texts)], sets, strict=True)]
                at += len(texts)
                yield pd.DataFrame(out, columns=["id", "n", "cls", "sketch", "bands"]).assign(row_hash=frame["row_hash"].to_numpy()[at - len(texts) : at])
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row_hash", row_hash("id", "text"))
    return rows.mapInPandas(run, "id long, n long, cls binary, sketch array<long>, bands array<long>, row_hash long")


def likely(x: str, y: str, floor: float) -> Column:
    """Sizes and sketches of x and y allow a link: fewer differing bits than at SKETCH_FLOOR, similar sizes."""
    differ = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (differ <= most_ones()) & (F.least(f"{x}.n", f"{y}.n") >= floor * F.greatest(f"{x}.n", f"{y}.n"))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
        for frame in frames:
            keep = []
            for b, ta, tb in zip(frame["b"].tolist(), frame["ta"].tolist(), frame["tb"].tolist(), strict=True):
                if last[0] != b:
                    last = (b, next(shingle_hashes([tb])))
                x, y = next(shingle_hashes([ta])), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield frame.loc[keep, ["a", "b"]]
        give_back()

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def most_ones() -> float:
    """Differing bits of two sketches expected at SKETCH_FLOOR."""
    return SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - SKETCH_FLOOR) / SKETCH_BITS))


def candidates(frame: pd.DataFrame, percent: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, int, np.ndarray]]:
    """(outsiders, members, number of an outsider, numbers of the members that its sketch may link with) of a block."""
    out, all_ = (frame[frame["outside"] == side].reset_index(drop=True) for side in (True, False))
    if not len(out) or not len(all_):
        return
    band = int(frame["band"].iloc[0])
    sk, bands = np.array(all_["sketch"].tolist(), np.int64).view(np.uint64), np.array(all_["bands"].tolist(), np.int64)
    labels, sizes = all_["label"].to_numpy(), all_["n"].to_numpy()
    for k in range(len(out)):
        ones = np.bitwise_count(sk ^ np.array(out["sketch"].iat[k], np.int64).view(np.uint64)).sum(1)
        n = out["n"].iat[k]
        near = np.flatnonzero((ones <= most_ones()) & (labels != out["label"].iat[k]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
        # a pair that shares several bands is checked in the first of them
        near = near[(bands[near] == np.array(out["bands"].iat[k], np.int64)).argmax(1) == band]
        if len(near):
            yield out, all_, k, near[np.argsort(ones[near], kind="stable")]


def asked(rows: DataFrame, percent: int) -> DataFrame:
    """(key, bo, bm, id) of those whose texts a block needs."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = {i for out, all_, k, near in candidates(frame, percent) for i in (out["id"].iat[k], *all_["id"].to_numpy()[near].tolist())}
        return pd.DataFrame({"id": np.array(sorted(ids), np.int64)}).assign(key=frame["key"].iloc[0], bo=frame["bo"].iloc[0], bm=frame["bm"].iloc[0])[["key", "bo", "bm", "id"]]

    return rows.groupBy("key", "bo", "bm").applyInPandas(run, "key long, bo long, bm long, id long")


def link_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the outsiders and the members of each group (key, bo, bm); one for each two labels joined."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        up: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def of(part: pd.DataFrame, k: int) -> np.ndarray:
            i = part["id"].iat[k]
            if i not in sets:
                sets[i] = next(shingle_hashes([part["text"].iat[k]]))
            return sets[i]

        def root(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for out, all_, k, near in candidates(frame, percent):
            for j in near.tolist():
                x, y = root(out["label"].iat[k]), root(all_["label"].iat[j])
                if x == y:
                    continue
                s, t = of(out, k), of(all_, j)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    up[max(x, y)] = min(x, y)
                    found.append((out["id"].iat[k], all_["id"].iat[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "bo", "bm").applyInPandas(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, row_hash (of id and text).

    Texts without words (null ones too) have no shingles and stay alone; a text
    of one to four words is one shingle. component_id is the smallest id that
    links lead to, kept marks it. Ids must be integers. Rows that repeat an id with
    another text are judged each by their own text, rows that repeat both get the
    same answer; a null id links with nothing and is not kept. Empty input, no
    rows. The bands find pairs from a similarity of 75 on, so a lower `percent` is
    an error.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent has to lie between 75 and 100")
    floor = percent / 100
    signed = materialise(sign(docs, id_col, text_col), "signed")
    reps = signed.filter("n > 0 AND id IS NOT NULL").groupBy("cls").agg(F.min(F.struct("id", "row_hash")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    # a class is named by its smallest id; where classes may share it, by a hash
    name = F.when(repeated_ids(signed, "id"), F.xxhash64("cls")).otherwise(F.col("id"))
    reps = materialise(reps.select("cls", F.col("row.id").alias("id"), F.col("row.row_hash").alias("row_hash"), "n", "sketch", "bands").select("*", F.col("id").alias("first_id")).withColumn("id", name), "classes")
    banded = reps.select("id", F.posexplode("bands").alias("band", "key"))
    heads = materialise(banded.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("head")).filter("c > 1"), "heads")
    members = materialise(spread_join(banded, heads, ["key"], "c", ["id"], HOT), "members")
    forget(heads)
    about = materialise(reps.select("id", "first_id", "row_hash", "n", "sketch", "bands").join(members.select("id").distinct(), "id", "left_semi"), "about")
    words = bit_filter(about.select("first_id"), "first_id", 22).scalar()
    texts = docs.select(F.col(id_col).cast("long").alias("first_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter(might_contain(words, F.col("first_id"), 22)).withColumn("row_hash", row_hash("first_id", "text"))
    texts = materialise(texts.join(about.select("id", "first_id", "row_hash"), ["first_id", "row_hash"]).select("id", "text").dropDuplicates(["id"]), "texts")
    about = about.drop("first_id", "row_hash")

    def undecided(labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several components."""
        placed = members.join(labels, F.col("id") == F.col("node"), "left").select("key", "band", "c", "id", F.coalesce("label", "id").alias("label"))
        several = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("c").alias("size")).filter("lo < hi").select("key", "size")
        return spread_join(placed, materialise(several, "several"), ["key"], "size", ["id"], HOT).drop("size")

    x, y = about.alias("x"), about.alias("y")
    star = members.filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    star = star.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).filter(likely("x", "y", floor)).select("a", "b")
    links = materialise(confirm(star, texts, percent), "links")
    labels = materialise(components(links), "labels")

    large = materialise(undecided(labels).filter(F.col("c") > SMALL), "large")
    if not large.isEmpty():
        common = large.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("common"), F.sum("k").alias("all"), F.max("k").alias("most"))
        both = spread_join(large, materialise(common, "common"), ["key"], "all", ["id"], HOT).withColumn("nm", F.ceil(F.col("all") / BLOCK)).withColumn("no", F.ceil((F.col("all") - F.col("most")) / BLOCK))
        spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        every = both.withColumn("outside", F.lit(False)).withColumn("bm", spot("nm")).withColumn("bo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("no") - 1)))
        outside = both.filter("label <> common").withColumn("outside", F.lit(True)).withColumn("bo", spot("no")).withColumn("bm", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)))
        cols = ["key", "bo", "bm", "band", "outside", "id", "label"]
        rows = materialise(every.select(*cols).unionByName(outside.select(*cols)).join(about, "id"), "blocks")
        wanted = materialise(asked(rows, percent), "asked")
        more = materialise(link_blocks(rows.join(wanted, ["key", "bo", "bm", "id"], "left_semi").join(texts, "id"), percent), "links")
        forget(rows)
        forget(wanted)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = materialise(components(links), "labels")
    forget(large)

    full = undecided(labels).filter(F.col("c") <= SMALL).join(about, "id").select("key", "id", "label", "n", "sketch")
    x, y = full.alias("x"), full.alias("y")
    wanted = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & likely("x", "y", floor)
    pairs = x.join(y, wanted).select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct()
    more = materialise(confirm(pairs.join(star, ["a", "b"], "left_anti"), texts, percent), "links")
    if not more.isEmpty():
        labels = materialise(components(links.unionByName(more)), "labels")
    classes = reps.select("cls", "first_id", F.col("id").alias("rep")).join(labels, F.col("rep") == F.col("node"), "left").select("cls", "first_id", F.coalesce("label", "rep").alias("label"))
    other = classes.groupBy("label").agg(F.min("first_id").alias("least")).filter("least <> label")  # only where a hash names a class
    classes = classes.join(other, "label", "left").select("cls", F.coalesce("least", "label").alias("component_id"))
    for done in (members, texts):
        forget(done)
    out = signed.select("id", "n", "cls", "row_hash").join(classes, "cls", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), "row_hash")


#: All pairs of texts that share a shingle, and what links reach: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""
