"""Importance resampling towards a target distribution, by hashed word runs.

Two passes over the texts, both in Arrow batches. The first gives one vector of
BUCKETS counts for each partition (np.bincount), which treeReduce merges. The
second gathers each feature's gain from the broadcast vector of gains and sums
them by document, again with np.bincount. Gumbel noise from a hash of the id
makes the draw without replacement one sort: the highest scores stay.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise
from textloom.operators.ranking import sorted_rank

BUCKETS = 10_000
#: Words that a worker remembers with their buckets, and the bytes of the longest: 60 MB at the worst.
MEMO, LONGEST = 300_000, 48
#: Bytes of text that are split at once; a batch holds at least one whole text.
PART = 1 << 22
#: A-Z to a-z, and every ASCII byte that is no digit or letter to a space.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Buckets(dict[bytes, int]):
    """Bucket of each feature: the crc32 of its bytes, modulo `size`; short ones are remembered."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.size
        if len(feature) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[feature] = bucket
        return bucket


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(WORDS).split()


def runs(found: list[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to `longest` consecutive words, joined by one space."""
    yield from found
    for n in range(2, longest + 1):
        yield from (b" ".join(found[k : k + n]) for k in range(len(found) - n + 1))


def features(texts: list[str | None], longest: int, memo: Buckets) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, words of each text, features of each text, bucket of each feature), PART bytes of text at a time."""
    at = 0
    while at < len(texts):
        n_words, sizes, flat, used, first = [], [], [], 0, at
        while at < len(texts) and (used < PART or at == first):
            found = words(texts[at])
            n_words.append(len(found))
            got = found if longest == 1 else list(runs(found, longest))
            sizes.append(len(got))
            flat += got
            used += len(texts[at] or "")
            at += 1
        yield first, np.array(n_words, np.int64), np.array(sizes, np.int64), np.fromiter(map(memo.__getitem__, flat), np.int64, len(flat))


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket: one vector a partition, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in batches:
            for *_, found in features(batch.column(0).to_pylist(), longest, memo):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)  # a table without partitions has no vector
    return vectors.union(none).treeReduce(np.add, depth=2)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of target to source) of each bucket, in doubles."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.float64)


def noise(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_words, n_features, weight, score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, memo = sent.value, Buckets(len(sent.value))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, n_words, sizes, found in features(batch.column(1).to_pylist(), longest, memo):
                part = ids[first : first + len(sizes)]
                weight = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=gain[found], minlength=len(sizes)).astype(np.int64)
                score = weight + np.fromiter(map(noise, repeat(seed), part), np.int64, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *map(pa.array, (n_words, sizes, weight, score))], ["id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (null: not drawn).

    Of the N rows with at least `least_words` words, floor(percent * N / 100) are
    drawn, those with the highest scores, ties to the smaller id (a null id last,
    with the noise of an empty id; rows that repeat an id and score in any order).
    A null or empty text has no features and weight 0. An empty target or source
    counts as one without features; no documents give no rows. Only the named
    columns are read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))
    scored = materialise(weigh(docs, gains, seed, longest, id_col, text_col), "scored")
    drawn = scored.filter(F.col("n_words") >= least_words).count() * percent // 100
    order = F.col("n_words") >= least_words
    keyed = scored.filter(order).select("*", (-F.col("score")).alias("_down"), F.col("id").isNull().alias("_none"), F.monotonically_increasing_id().alias("_row"))
    best = sorted_rank(keyed, ["_down", "_none", "id", "_row"], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    cols = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return best.select(*cols, "rank").unionByName(scored.filter(~order).select(*cols, F.lit(None).cast("long").alias("rank")))


#: The crc32 of a word's bytes, bit by bit over its hexadecimal form, of distinct words only.
SQL = r"""
WITH RECURSIVE w AS (SELECT 's' AS side, doc_id AS id, rn, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)
  UNION ALL SELECT 't', item_id, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bits AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
crc AS (SELECT word, xor(list_reduce(list_transform(range(0, length(hex(encode(word))) // 2), lambda j: CAST('0x' || substr(hex(encode(word)), CAST(2 * j + 1 AS INTEGER), 2) AS BIGINT)),
  lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), tab),
f AS (SELECT side, id, rn, bucket, count(*) AS n FROM w JOIN crc USING (word) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS s_all, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t_all FROM f),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (t_sum.s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_sum.t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t FROM f GROUP BY bucket), totals t_sum),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT doc_id, row_number() OVER () AS rn FROM documents) LEFT JOIN (SELECT rn, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN gains USING (bucket) WHERE side = 's' GROUP BY rn) USING (rn)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM d)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r
"""
