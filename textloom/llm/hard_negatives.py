"""Hard negatives by a Voronoi-partitioned kNN join on inner products.

A row gets one more component, sqrt(M - |v|^2) with M the largest squared norm,
anchors and pivots 0: the higher the inner product, the smaller the distance then
is. Anchors fall in the Voronoi cells of pivots, cells are joined to groups. From a
cell's radius and the distance of a row to its pivot follow bounds of the scores
that the row can have with the cell's anchors; a row is copied only to groups of
which a cell may want it. There, blocks of rows meet chunks of anchors exactly.

Two such joins run: one for the positives of each anchor, one for the rows in the
score bands under these positives. What a cell wants at least is known from a
bounded sample of rows that every anchor has met before: its k-th best score in
the sample can only rise. A group's rows are dealt over SLICES tasks, so that a
group with all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, materialise

#: Rows that every anchor meets first, the first of them pivots: a bound for what goes to the driver and to all tasks.
SAMPLE, PIVOTS = 4096, 256
#: Rows in a block, anchors in a chunk, tasks that share a group's rows, anchors of a group, label slots of a cell.
BLOCK, CHUNK, SLICES, GROUP, SLOTS = 2048, 2048, 16, 65_536, 64
#: Groups are split as long as the sample's rows go to this many on average.
COPIES = 1.5
LOW = -(1 << 62)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(col: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of an array column, shorter ones filled up with zeros."""
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if len(flat) == len(sizes) * dim:
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Space:
    """What all tasks know: pivots and sample, the largest squared norm, how numbers are kept."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    pivots: int
    most: int  # largest squared norm
    dtype: str
    exact: bool  # doubles hold every score exactly

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.float64) @ b.astype(np.float64).T if self.exact else a.astype(np.int64) @ b.astype(np.int64).T

    def row_distance(self, rows: np.ndarray) -> np.ndarray:
        """Distances of rows, with their further component, to the pivots, which have it at 0."""
        p = self.rows[: self.pivots].astype(np.float64)
        return np.sqrt(np.maximum(0.0, (p**2).sum(1) + self.most - 2.0 * self.scores(rows, p)))

    def anchor_distance(self, anchors: np.ndarray) -> np.ndarray:
        p = self.rows[: self.pivots].astype(np.float64)
        norms = (anchors.astype(np.float64) ** 2).sum(1)
        return np.sqrt(np.maximum(0.0, norms[:, None] + (p**2).sum(1) - 2.0 * self.scores(anchors, p)))


class Best:
    """The k best (score, id) of each row so far, only scores of at least `need`; ties to the smaller id."""

    def __init__(self, need: np.ndarray, k: int) -> None:
        self.need = need.astype(np.int64)
        self.score = np.full((len(need), k), LOW, np.int64)
        self.id = np.full((len(need), k), np.iinfo(np.int64).max, np.int64)

    def least(self) -> np.ndarray:
        return np.maximum(self.need, self.score[:, -1])

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        worst = self.score[row, -1]
        better = (score >= self.need[row]) & ((score > worst) | ((score == worst) & (ids < self.id[row, -1])))
        row, score, ids = row[better], score[better], ids[better]
        if not len(row):
            return
        k = self.score.shape[1]
        some = np.unique(row)
        row, score, ids = np.r_[row, np.repeat(some, k)], np.r_[score, self.score[some].ravel()], np.r_[ids, self.id[some].ravel()]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        first = (heads[:, None] + np.arange(k)).ravel()  # each row has k entries at least: those it had
        self.score[some], self.id[some] = score[first].reshape(-1, k), ids[first].reshape(-1, k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(self.score > LOW)
        return row, self.score[row, place], self.id[row, place]


def hits(scores: np.ndarray, low: np.ndarray, high: np.ndarray | None, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the scores between low and high that fit."""
    wanted = (scores >= low[:, None]) & fits
    if high is not None:
        wanted &= scores <= high[:, None]
    row, col = np.nonzero(wanted)
    return row, col, scores[row, col].astype(np.int64)


def meet_positives(best: Best, chunk: dict[str, np.ndarray], ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
    row, col, score = hits(scores, best.least(), None, (labels == chunk["label"][:, None]) & (ids != chunk["id"][:, None]))
    best.add(row, score, ids[col])


def meet_negatives(best: Best, chunk: dict[str, np.ndarray], ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
    """best has one row for each anchor and positive: row = anchor * places + place of the positive."""
    high = chunk["high"].reshape(len(chunk["id"]), -1)
    low = best.least().reshape(high.shape)
    open_ = low <= high
    row, col, score = hits(scores, np.where(open_, low, -LOW).min(1), np.where(open_, high, LOW).max(1), (labels != chunk["label"][:, None]) & (ids != chunk["id"][:, None]))
    for place in range(high.shape[1]):
        ok = (score >= low[row, place]) & (score <= high[row, place])
        best.add(row[ok] * high.shape[1] + place, score[ok], ids[col[ok]])


def locate(anchors: DataFrame, space: Space, positives: int) -> DataFrame:
    """Anchors with their cell, distance to its pivot, squared norm, and the score that their positives have at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rows = matrix(part.column("v"), space.rows.shape[1])
                chunk = {"id": part.column("id").to_numpy(), "label": part.column("label").to_numpy()}
                distance = space.anchor_distance(rows)
                cell = distance.argmin(1)
                best = Best(np.full(len(rows), LOW, np.int64), positives)
                meet_positives(best, chunk, space.ids, space.labels, space.scores(rows, space.rows))
                vecs = pa.array([r.tobytes() for r in rows.astype(space.dtype)], pa.binary())
                norm = (rows.astype(np.int64) ** 2).sum(1)
                cols = [part.column("key"), part.column("id"), part.column("label"), vecs, pa.array(cell.astype(np.int32)), pa.array(distance[np.arange(len(rows)), cell]), pa.array(norm), pa.array(best.score[:, -1])]
                yield pa.RecordBatch.from_arrays(cols, ["key", "id", "label", "vec", "cell", "radius", "norm", "need"])

    return anchors.mapInArrow(run, "key long, id long, label long, vec binary, cell int, radius double, norm long, need long")


def bands(anchors: DataFrame, space: Space, low: int, high: int, negatives: int) -> DataFrame:
    """Anchors with, for each of their positives, the highest score of a negative, and the score that the chosen ones have at least."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), CHUNK):
                frame = whole.iloc[at : at + CHUNK].reset_index(drop=True)
                places = max(map(len, frame["positives"]))
                score = np.full((len(frame), places), -1, np.int64)  # under 0 no score meets both conditions
                for k, found in enumerate(frame["positives"]):
                    score[k, : len(found)] = [-p["down"] for p in found]
                least, most = -(-low * score // 100), np.where(score < 0, LOW, high * score // 100)
                rows = np.stack([np.frombuffer(v, space.dtype) for v in frame["vec"]])
                best = Best(least.ravel(), negatives)
                meet_negatives(best, {"id": frame["id"].to_numpy(), "label": frame["label"].to_numpy(), "high": most.ravel()}, space.ids, space.labels, space.scores(rows, space.rows))
                need = best.least().reshape(least.shape)
                empty = most < least
                yield frame.assign(high=list(most), need=list(need), top=most.max(1), bottom=np.where(empty, -LOW, need).min(1))[["key", "id", "label", "vec", "cell", "radius", "norm", "positives", "high", "need", "top", "bottom"]]

    kind = "key long, id long, label long, vec binary, cell int, radius double, norm long, positives array<struct<down: long, id: long>>, high array<long>, need array<long>, top long, bottom long"
    return anchors.mapInPandas(run, kind)


@dataclass
class Bounds:
    """For each cell: number, radius, norms of its anchors, what it wants at least by label slot, and at most; its group."""

    n: np.ndarray
    radius: np.ndarray
    small: np.ndarray
    large: np.ndarray
    least: np.ndarray
    most: np.ndarray
    group: np.ndarray

    def wanted(self, space: Space, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which rows the cells may want."""
        away = space.row_distance(rows)
        slack = 1e-6 * (1.0 + space.most)
        up = (self.large + space.most - np.maximum(0.0, away - self.radius) ** 2) / 2 + slack
        down = (self.small + space.most - (away + self.radius) ** 2) / 2 - slack
        return (up >= self.least[:, labels % self.least.shape[1]].T) & (down <= self.most) & (self.n > 0)

    def groups(self, space: Space, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Which rows go to which groups."""
        wanted = self.wanted(space, rows, labels)
        return np.stack([wanted[:, self.group == g].any(1) for g in range(self.group.max() + 1)], 1)


def near_order(points: np.ndarray, idx: np.ndarray) -> list[int]:
    """Points in an order in which neighbours are near, by splitting between two far ones."""
    if len(idx) < 3:
        return idx.tolist()
    a = points[idx[((points[idx] - points[idx[0]]) ** 2).sum(1).argmax()]]
    b = points[idx[((points[idx] - a) ** 2).sum(1).argmax()]]
    idx = idx[np.argsort(points[idx] @ (b - a), kind="stable")]
    return near_order(points, idx[: len(idx) // 2]) + near_order(points, idx[len(idx) // 2 :])


def summarise(anchors: DataFrame, space: Space, least: Column, most: Column, slots: int) -> Bounds:
    """Bounds of the cells, and the finest groups whose copies stay few. PIVOTS * slots rows at most go to the driver."""
    slot = F.pmod("label", F.lit(slots)).cast("int") if slots > 1 else F.lit(0)
    rows = anchors.groupBy("cell", slot.alias("slot")).agg(F.count("*"), F.max("radius"), F.min("norm"), F.max("norm"), F.min(least), F.max(most)).collect()
    k = space.pivots
    out = Bounds(np.zeros(k, np.int64), np.zeros(k), np.full(k, np.inf), np.zeros(k), np.full((k, slots), np.inf), np.full(k, -np.inf), np.zeros(k, np.int64))
    for cell, s, n, radius, small, large, low, high in rows:
        out.n[cell] += n
        out.radius[cell], out.small[cell], out.large[cell] = max(out.radius[cell], radius), min(out.small[cell], small), max(out.large[cell], large)
        out.least[cell, s], out.most[cell] = low, max(out.most[cell], high)
    pivots = space.rows[:k].astype(np.float64)
    order = np.array(near_order(pivots, np.arange(k)))
    before = np.cumsum(out.n[order]) - out.n[order]
    fewest = int(-(-out.n.sum() // GROUP))
    n = max(fewest, k)
    while True:
        out.group[order] = np.minimum(n - 1, before * n // max(1, out.n.sum()))
        out.group = np.unique(out.group, return_inverse=True)[1]
        if n <= max(1, fewest) or out.groups(space, space.rows, space.labels).sum(1).mean() <= COPIES:
            return out
        n = max(fewest, n // 2)


def blocks(vectors: DataFrame, space: Space, bounds: Bounds) -> DataFrame:
    """Blocks of rows for each group that may want them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        turn = task.partitionId() if task else 0
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def packed(g: int) -> pa.RecordBatch:
            nonlocal turn
            ids, labels, rows = (np.concatenate(x) for x in zip(*held.pop(g), strict=True))
            turn += 1
            cols = [[g], [turn % SLICES], [ids.tobytes()], [labels.tobytes()], [rows.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["group", "slice", "ids", "labels", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, labels, rows = part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), space.rows.shape[1])
                to = bounds.groups(space, rows, labels)
                for g in np.flatnonzero(to.any(0)).tolist():
                    some = to[:, g]
                    held.setdefault(g, []).append((ids[some], labels[some], rows[some].astype(space.dtype)))
                    if sum(len(x[0]) for x in held[g]) >= BLOCK:
                        yield packed(g)
        for g in list(held):
            yield packed(g)

    return vectors.mapInArrow(run, "group int, slice int, ids binary, labels binary, rows binary")


def chunks(anchors: DataFrame, bounds: Bounds, extra: list[str]) -> DataFrame:
    """Anchors of a group in chunks of about CHUNK, each for all slices."""
    sizes = np.bincount(bounds.group, weights=bounds.n)
    group = F.element_at(F.lit(bounds.group.tolist()), F.col("cell") + 1).cast("int")
    parts = F.element_at(F.lit([max(1, int(-(-s // CHUNK))) for s in sizes]), F.col("group") + 1)
    placed = anchors.withColumn("group", group).withColumn("chunk", F.pmod(F.xxhash64("key"), parts).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        flat = {c: np.concatenate([np.asarray(x, np.int64) for x in frame[c]]).tobytes() if frame[c].dtype == object else frame[c].to_numpy(np.int64).tobytes() for c in ("key", "id", "label", *extra)}
        return pd.DataFrame([{"group": frame["group"].iat[0], "chunk": frame["chunk"].iat[0], **flat, "vecs": b"".join(frame["vec"])}])

    kinds = "".join(f", {c} binary" for c in ("key", "id", "label", *extra))
    packed = placed.select("group", "chunk", "key", "id", "label", "vec", *extra).groupBy("group", "chunk").applyInPandas(pack, f"group int, chunk int{kinds}, vecs binary")
    return packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))


def local_join(pairs: DataFrame, space: Space, k: int, meet: Callable, extra: list[str]) -> DataFrame:
    """(key, place, score, id): the best of each chunk's anchors among the blocks of a task; few chunks are open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, int], tuple[Best, dict[str, np.ndarray], np.ndarray]] = {}

        def closed(name: tuple[int, int]) -> pa.RecordBatch:
            best, chunk, _ = open_.pop(name)
            row, score, ids = best.found()
            places = len(best.need) // len(chunk["id"])
            return pa.RecordBatch.from_arrays([pa.array(chunk["key"][row // places]), pa.array((row % places).astype(np.int32)), pa.array(score), pa.array(ids)], ["key", "place", "score", "id"])

        for batch in batches:
            for pair in (batch.slice(n, 1) for n in range(batch.num_rows)):
                get = lambda c, pair=pair: pair.column(c)[0].as_py()
                name = (get("group"), get("chunk"))
                if name not in open_:
                    if len(open_) >= 2 * GROUP // CHUNK:
                        yield closed(next(iter(open_)))
                    chunk = {c: np.frombuffer(get(c), np.int64) for c in ("key", "id", "label", *extra)}
                    need = chunk["need"]
                    open_[name] = Best(need, k), chunk, np.frombuffer(get("vecs"), space.dtype).reshape(len(chunk["id"]), -1)
                best, chunk, vecs = open_[name]
                ids, labels = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("labels"), np.int64)
                rows = np.frombuffer(get("rows"), space.dtype).reshape(len(ids), -1)
                meet(best, chunk, ids, labels, space.scores(vecs, rows))
        for name in list(open_):
            yield closed(name)

    return pairs.mapInArrow(run, "key long, place int, score long, id long")


def joined(vectors: DataFrame, anchors: DataFrame, space: Space, bounds: Bounds, k: int, meet: Callable, extra: list[str]) -> DataFrame:
    """For each key and place, `best`: its k best rows as (down: minus the score, id), in order."""
    pairs = blocks(vectors, space, bounds).join(chunks(anchors, bounds, extra), ["group", "slice"])
    found = local_join(pairs, space, k, meet, extra)
    return found.groupBy("key", "place").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))), 1, k).alias("best"))


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Columns RESULT: for each anchor (id divisible by `every`) and each of its positives, its hard negatives.

    Components become floor(scale * x); the score of two rows is their inner
    product. An anchor's positives are its first `positives` rows of the same label
    and another id; the negatives of each are the first `negatives` rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score.
    First is the higher score, then the smaller id. Rows without an id, label or
    vector, or with a null or non-finite component take no part. A shorter vector
    counts as filled up with zeros. Ids and labels must be integers. Rows that
    repeat an id are rows each, but never partners of an anchor of that id; an
    anchor repeated whole is asked once. Raises if a score might not fit 63 bits.
    No anchors, no rows; other columns are not read.
    """
    spark = rows.sparkSession
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    vectors = materialise(whole.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, dim, most, widest, asked = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm), F.max(F.array_max(F.transform("v", F.abs))), F.count_if(F.col("id") % every == 0)).first()
    if not asked:
        return spark.createDataFrame([], RESULT)
    if most >= 1 << 61:
        raise ValueError("components are too large: scores have to fit 63 bits")
    widest = widest or 0
    drawn = vectors.orderBy(F.xxhash64("id", "label"), "id", "label", "v").limit(SAMPLE).toArrow().combine_chunks()
    column = lambda c: drawn.column(c).combine_chunks()
    dtype = next(t for t, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if widest < 1 << bits)
    space = Space(column("id").to_numpy(), column("label").to_numpy(), matrix(column("v"), dim), max(1, min(PIVOTS, int(count**0.5) // 2, drawn.num_rows)), int(most), dtype, most < 1 << 52)

    anchors = vectors.filter(F.col("id") % every == 0).dropDuplicates(["id", "label", "v"]).withColumn("key", F.monotonically_increasing_id())
    anchors = materialise(locate(anchors, space, positives), "anchors")
    bounds = summarise(anchors, space, F.col("need"), F.lit(float("inf")), SLOTS)
    first = joined(vectors, anchors, space, bounds, positives, meet_positives, ["need"])
    banded = materialise(bands(anchors.drop("need").join(first.select("key", F.col("best").alias("positives")), "key"), space, low, high, negatives).filter("top > -1"), "banded")
    forget(anchors)
    bounds = summarise(banded, space, F.col("bottom"), F.col("top"), 1)
    second = materialise(joined(vectors, banded, space, bounds, negatives, meet_negatives, ["high", "need"]), "negatives")
    names = banded.select("key", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("place", "p"))
    every_one = second.join(names, ["key", "place"]).select("anchor_id", "p", F.posexplode("best").alias("rank", "n"))
    forget(vectors)
    return every_one.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), (-F.col("p.down")).alias("positive_score"), (-F.col("n.down")).alias("negative_score"))


#: Every anchor against every row.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""
