"""Repeated byte strings of at least `length` bytes, by hash grouping on anchors.

Every window of `length` bytes is filed under its anchor: the leftmost GRAM-byte
string in it with the smallest hash. Equal windows have equal anchors, at equal
places, so only windows of equal anchors can be equal, and the windows of one
anchor lie side by side. 64-bit hashes are then grouped in Spark, once each:

1. of the anchor's GRAM bytes; anchors that are unique drop out with all their
   windows;
2. of the anchor with all bytes that its windows cover; where that whole string
   occurs again, all its windows do;
3. what is left - anchors that occur again, in other surroundings - has its
   single windows hashed, at the full length, and compared with one anchor of
   each of the other surroundings.

This replaces prefix doubling, which doubled() holds: it gives the same result,
but names every position under a repeated anchor in each round, which is more than
the check tool's disk allows (see the README). Anchors keep the rows that Spark
groups to about one for every 70 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SpanHasher, bit_filter, forget, materialise, might_contain, repeated_ids, spread_join

LENGTH, GRAM = 200, 64
PLACE = 20
CHUNK = 1 << PLACE
hasher = SpanHasher()


def pieces(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, hash prefix, anchor, first window, last window) of pieces of a text; anchors and windows count from the piece's place.

    Each has at most CHUNK bytes, so that the arrays of a very long text stay small.
    """
    per = length - gram + 1
    for base in range(0, max(0, len(data) - length + 1), CHUNK - length):
        windows = min(CHUNK - length, len(data) - length + 1 - base)
        prefix = hasher.prefix(data[base : base + windows + length - 1])
        at = np.arange(windows + per - 1)
        value = hasher.spans(prefix, at, at + gram) >> np.uint64(PLACE) << np.uint64(PLACE) | at.astype(np.uint64)
        size = 1
        while size * 2 <= per:
            value = np.minimum(value[:-size], value[size:])
            size *= 2
        if rest := per - size:
            value = np.minimum(value[:-rest], value[rest:])
        anchor = (value & np.uint64(CHUNK - 1)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        yield base, prefix, anchor[heads], heads, np.r_[heads[1:], windows] - 1


def raw(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first..last."""
    many = last - first + 1
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def rank_anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, hs, ks, gs, fs = [], [], [], [], []
            for i, h, text in zip(frame["id"].tolist(), frame["h"].tolist(), frame["text"].tolist(), strict=True):
                n = 0
                for _, prefix, at, first, last in pieces(raw(text), length):
                    ids.append(np.full(len(at), i, np.int64))
                    hs.append(np.full(len(at), h, np.int64))
                    ks.append(np.arange(n, n + len(at), dtype=np.int32))
                    gs.append(hasher.spans(prefix, at, at + GRAM))
                    fs.append(hasher.spans(prefix, first, last + length))
                    n += len(at)
            if ids:
                yield pd.DataFrame({"g": np.concatenate(gs).view(np.int64), "f": np.concatenate(fs).view(np.int64), "id": np.concatenate(ids), "h": np.concatenate(hs), "k": np.concatenate(ks)})

    return docs.mapInPandas(run, "g long, f long, id long, h long, k int")


def chosen(data: np.ndarray, ks: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, hash prefix, first, last, which of ks) of the anchors `ks`, piece by piece; ks counts through the text."""
    order = np.argsort(ks, kind="stable")
    n = at = 0
    for base, prefix, anchor, first, last in pieces(data, length):
        end = at + int(np.searchsorted(ks[order[at:]], n + len(anchor)))
        mine = order[at:end]
        if len(mine):
            yield base, prefix, first[ks[mine] - n], last[ks[mine] - n], mine
        n, at = n + len(anchor), end


def rank_windows(rows: DataFrame, length: int) -> DataFrame:
    """Single windows of the anchors `ks` of each text; `open` ones are still undecided."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, h, text, ks, undecided in zip(frame["id"].tolist(), frame["h"].tolist(), frame["text"].tolist(), frame["ks"].tolist(), frame["opens"].tolist(), strict=True):
                undecided = np.asarray(undecided, bool)
                for base, prefix, first, last, mine in chosen(raw(text), np.asarray(ks, np.int64), length):
                    start = spread(first, last)
                    yield pd.DataFrame({"w": hasher.spans(prefix, start, start + length).view(np.int64), "id": i, "h": h, "start": (start + base).astype(np.int32), "open": np.repeat(undecided[mine], last - first + 1)})

    return rows.mapInPandas(run, "w long, id long, h long, start int, open boolean")


def cut(rows: DataFrame, length: int) -> DataFrame:
    """Removes the bytes under the windows of the anchors `ks` and under the windows `starts`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text, ks, starts in zip(frame["id"].tolist(), frame["text"].tolist(), frame["ks"].tolist(), frame["starts"].tolist(), strict=True):
                data = raw(text)
                edge = np.zeros(len(data) + 1, np.int32)
                first = np.asarray(starts if starts is not None else [], np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + length, -1)
                if ks is not None and len(ks):
                    for base, _, first, last, _ in chosen(data, np.asarray(ks, np.int64), length):
                        np.add.at(edge, first + base, 1)
                        np.add.at(edge, last + base + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
                out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInPandas(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, doubling: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes under any `length`-byte string that starts anywhere else too are removed,
    in every place. Texts shorter than that keep all; null counts as empty. Ids
    must be integers. Rows are told apart by id and text: rows that repeat an id
    with another text, and rows without an id, are judged by their own text, and
    rows that repeat both count as two texts. Empty input, no rows; only the two
    named columns are read. With `doubling`, places are found by prefix doubling
    over all positions under anchors that occur again.
    """
    base = docs.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).cast("string").alias("text"))
    # h tells texts of one id apart; it is 0, and costs nothing, for ids that aren't repeated
    mark = F.when(repeated_ids(base, "given"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    base = base.select("given", F.coalesce("given", F.xxhash64("text", F.lit("no id"))).alias("id"), mark.alias("h"), "text")
    ranks = materialise(rank_anchors(base.select("id", "h", "text"), length), "ranks")

    def with_text(rows: DataFrame) -> DataFrame:
        """Joins texts by row; a fixed-size bitmap keeps the other texts out of the shuffle."""
        ids = bit_filter(rows.select("id"), "id", 22).scalar()
        return base.select("id", "h", "text").filter(might_contain(ids, F.col("id"), 22)).join(rows, ["id", "h"])

    if doubling:
        found = doubled(ranks, with_text, length)
    else:
        found = grouped(ranks, with_text, length)
    ids = bit_filter(found.select("id"), "id", 22).scalar()
    met = F.coalesce(might_contain(ids, F.col("id"), 22), F.lit(False))
    near = base.filter(met).join(found.withColumn("hit", F.lit(True)), ["id", "h"], "left")
    plain = base.filter(~met).unionByName(near.filter("hit IS NULL").select("given", "id", "h", "text"))
    zero = F.lit(0).cast("long")
    plain = plain.select("given", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return cut(near.filter("hit").select(F.col("given").alias("id"), "text", "ks", "starts"), length).withColumnRenamed("id", "given").unionByName(plain).withColumnRenamed("given", id_col)


def grouped(ranks: DataFrame, with_text: Callable[[DataFrame], DataFrame], length: int) -> DataFrame:
    """(id, h, ks, starts): anchors all of whose windows occur again, and single windows that do."""
    pairs = materialise(ranks.groupBy("g", "f").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "k")).alias("at")), "pairs")
    grams = pairs.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.count_if(F.col("n") == 1).alias("open")).filter("total > 1")
    grams = materialise(grams.select("g", "rows", "open"), "grams")
    live = materialise(spread_join(pairs, grams, ["g"], "rows", ["f"]).select("g", "f", "n", "at", "open"), "live")
    forget(pairs)
    forget(grams)

    twice = materialise(live.filter("n > 1").select("g", "f", "n"), "twice")
    words = bit_filter(twice.select("f"), "f", 24).scalar()
    again = spread_join(ranks.filter(might_contain(words, F.col("f"), 24)), twice, ["g", "f"], "n", ["id", "h", "k"])
    again = materialise(again.groupBy("id", "h").agg(F.collect_list("k").alias("ks")), "again")
    forget(ranks)
    forget(twice)

    asked = live.filter("open > 0").select("at.id", "at.h", "at.k", (F.col("n") == 1).alias("open")).groupBy("id", "h").agg(F.collect_list(F.struct("k", "open")).alias("x"))
    asked = materialise(asked.select("id", "h", F.col("x.k").alias("ks"), F.col("x.open").alias("opens")), "asked")
    forget(live)
    windows = materialise(rank_windows(with_text(asked), length), "windows")
    hits = materialise(windows.groupBy("w").agg(F.count("*").alias("c"), F.max("open").alias("open")).filter("c > 1 AND open").select("w", "c"), "hits")
    singles = spread_join(windows.filter("open"), hits, ["w"], "c", ["id", "start"]).groupBy("id", "h").agg(F.collect_list("start").alias("starts"))
    found = materialise(again.join(singles, ["id", "h"], "full_outer"), "found")
    for done in (windows, hits, asked, again):
        forget(done)
    return found


def doubled(ranks: DataFrame, with_text: Callable[[DataFrame], DataFrame], length: int) -> DataFrame:
    """(id, h, ks, starts) by prefix doubling: names of GRAM bytes, then of pairs of names at growing offsets, until `length`.

    In each round names that occur once drop out with their positions; the other
    positions are sorted by name, paired with the one `offset` on, and named anew.
    Positions start as those under windows of anchors that occur again.
    """
    many = ranks.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    asked = spread_join(ranks.select("g", "id", "h", "k"), materialise(many, "many"), ["g"], "n", ["id", "k"]).groupBy("id", "h").agg(F.collect_list("k").alias("ks"))

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, h, text, ks in zip(frame["id"].tolist(), frame["h"].tolist(), frame["text"].tolist(), frame["ks"].tolist(), strict=True):
                for base, prefix, first, last, _ in chosen(raw(text), np.asarray(ks, np.int64), length):
                    at = np.unique(spread(first, last + length - GRAM))
                    yield pd.DataFrame({"name": hasher.spans(prefix, at, at + GRAM).view(np.int64), "id": i, "h": h, "at": (at + base).astype(np.int32)})

    named = materialise(with_text(materialise(asked, "asked")).mapInPandas(grams, "name long, id long, h long, at int").distinct(), "names")
    forget(ranks)
    size = GRAM
    while True:
        often = materialise(named.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"), "often")
        kept = materialise(spread_join(named, often, ["name"], "n", ["id", "at"]).select("name", "id", "h", "at").sortWithinPartitions("name"), "kept")
        forget(named)
        forget(often)
        if size == length:
            break
        offset = min(size, length - size)
        ahead = kept.select("id", "h", (F.col("at") - offset).alias("at"), F.col("name").alias("then"))
        named = materialise(kept.join(ahead, ["id", "h", "at"]).select(F.xxhash64("name", "then").alias("name"), "id", "h", "at"), "names")
        forget(kept)
        size += offset
    none = F.lit(None).cast("array<int>")
    found = materialise(kept.groupBy("id", "h").agg(F.collect_list("at").alias("starts")).select("id", "h", none.alias("ks"), "starts"), "found")
    forget(kept)
    return found


#: Every window of 200 bytes of every text, by hash: for small tables.
SQL = """
WITH d AS (SELECT doc_id, bytes, hex(bytes) AS hx, octet_length(bytes) AS n FROM (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents)),
win AS (SELECT doc_id, i, hash(bytes[i + 1 : i + 200]) AS h FROM (SELECT doc_id, bytes, unnest(range(0, greatest(n - 199, 0))) AS i FROM d)),
again AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark) GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
cut AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(hx, CAST(2 * z + 1 AS BIGINT), CAST(2 * (a - z) AS BIGINT)), '' ORDER BY a) || substr(first(hx), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
