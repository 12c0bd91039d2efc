"""Sequences of at most `capacity` tokens by hierarchical residual packing.

Each input split packs its own pieces best-fit, longest first. Bins that are
nearly full are final; underfull ones go, as items, to the next round, where
bins of fan_in groups meet and are packed best-fit again, until one group is
left. Where that would make groups too large, bins are dealt to groups anew in
each round, until a round no longer lowers the number of underfull ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, give_back, materialise

#: A bin's id is its round, from this bit on, then its split and, in the lower 32 bits, its number there.
SHIFT = 52
PIECES = "id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest items first, each into the fullest bin that it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens of room
    n = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if size and fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = n, capacity
            n += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def cut(docs: DataFrame, id_col: str, text_col: str, tokenizer_json: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents, packed within their split."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from textloom.llm.tokens import batches, encoder

        enc = encoder(shipped.value)
        rows: list[tuple] = []
        for frame in frames:
            ids = iter(frame["id"].tolist())
            for texts in batches(frame["text"].tolist()):
                for got in enc.encode(texts):
                    got = np.append(got, np.uint32(end_id)).astype("<u4")
                    doc = next(ids)
                    rows += [(doc, k, at, len(part := got[at : at + capacity]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(got), capacity))]
        out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])
        bins, offsets = best_fit(out["length"].to_numpy(np.int64), capacity)
        out["bin"], out["offset"] = bins + (TaskContext.get().partitionId() << 32), offsets
        yield out
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(pack, PIECES)


def merge_round(bins: DataFrame, groups: int, capacity: int, level: int, dealt: bool) -> DataFrame:
    """(bin, length) -> (bin, into, offset): best-fit of underfull bins inside each of `groups` groups, whole groups of the last round or bins dealt anew."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frame = pd.concat([pd.DataFrame({"bin": pd.Series(dtype="int64"), "length": pd.Series(dtype="int64")}), *frames]).sort_values(["length", "bin"], ascending=[False, True], ignore_index=True)
        at, offsets = best_fit(frame["length"].to_numpy(np.int64), capacity)
        into = at + ((level << SHIFT) | (TaskContext.get().partitionId() << 32))
        yield pd.DataFrame({"bin": frame["bin"], "into": into, "offset": offsets})

    key = F.col("bin") if dealt else F.pmod(F.shiftright("bin", 32), F.lit(groups))
    return bins.repartition(groups, key).mapInPandas(pack, "bin long, into long, offset long")


def pack_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, fan_in: int = 8, slack: int = 8, group_rows: int = 250_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's and end_id; only a longer one is cut, into
    pieces of `capacity`, the last one shorter. A null or empty text is one piece of
    end_id alone. Rows that repeat an id are packed as documents of their own.
    Offsets are gapless from 0 in each sequence. A bin within `slack` of capacity
    is final; others are merged in rounds of fan_in groups, of about group_rows
    bins or fewer each: with more bins than that, rounds go on with other groups
    until they no longer lower the number of underfull bins. Empty input gives no rows.
    """
    pieces = materialise(cut(docs, id_col, text_col, tokenizer_json, capacity, end_id), "pieces")
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("length"))
    placed = materialise(bins.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("offset"), "length"), "bins")
    groups = max(1, pieces.rdd.getNumPartitions())
    before, dealt = 0, False
    for level in range(1, 1 << 63 - SHIFT):
        fills = placed.groupBy("into").agg(F.sum("length").alias("length"))
        under = fills.filter(F.col("length") < capacity - slack).select(F.col("into").alias("bin"), "length")
        n = under.count()
        if n < 2 or dealt and n >= before:
            break
        before, least, fewer = n, -(-n // group_rows), -(-groups // fan_in)
        groups, dealt = max(least, fewer), least > fewer
        moved = materialise(merge_round(under, groups, capacity, level, dealt), "merge")
        step = moved.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("offset").alias("shift"))
        last, placed = placed, materialise(
            placed.join(step, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"), "length"), "bins"
        )
        forget(moved)
        forget(last)
        if groups == 1:  # no two bins of a group fit into one
            break
    where = placed.select("bin", F.col("into").alias("sequence_id"), F.col("offset").alias("shift"))
    return pieces.join(where, "bin").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("offset") + F.col("shift")).alias("offset"))
