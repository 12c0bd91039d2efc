"""Token ids in a compact binary format: canonical, length-limited Huffman codes.

Code lengths come from the counts of all ids of the corpus (package-merge, at
most max_bits). Documents lie in ascending id order in blocks that stand alone:
a block has its documents' ids and lengths, the packed bits, and the bit offset
of every STEP-th symbol, so that a decoder works on all checkpoints at once with
one table lookup for each symbol.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, materialise, scratch

STEP = 64
BLOCK = 1 << 18
#: Stands for a null id in the files: it sorts first.
NO_ID = -(1 << 63)
IDS = "id long, n long, ids binary"
BLOCKS = "part long, block long, doc_ids binary, doc_starts binary, doc_lengths binary, checkpoints binary, n long, bits binary"


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol's code (0: never used), optimal under max_bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    level, taken = weights, []  # taken: for each level, which of the sorted entries are packages
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        sort = np.argsort(both, kind="stable")
        taken.append(sort >= n)
        level = both[sort]
    need, bits = 2 * (n - 1), np.zeros(n, np.int64)
    for is_package in reversed(taken):
        head = is_package[:need]
        bits[: int((~head).sum())] += 1
        need = 2 * int(head.sum())
    bits[:need] += 1
    out[order] = bits
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by symbol."""
    out = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if size := int(lengths[s]):
            code <<= size - last
            out[s], last = code, size
            code += 1
    return out


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every value of the next `width` bits."""
    width = int(lengths.max(initial=1))
    of, symbol, size = codes(lengths), np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    order = np.flatnonzero(lengths)
    order = order[np.argsort(of[order] << (np.uint64(width) - lengths[order].astype(np.uint64)), kind="stable")]
    spans = 1 << (width - lengths[order].astype(np.int64))
    symbol[: spans.sum()], size[: spans.sum()] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbol, size, width


def encode_block(ids: np.ndarray, of: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Packed bits, and the bit offset of every STEP-th symbol."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, off = starts >> 6, starts & 63
    room = 64 - off - size
    code = of[ids]
    first = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[heads]] = np.add.reduceat(first, heads)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), starts[::STEP].astype("<u4")


def decode_block(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All lanes step together; each starts at a checkpoint."""
    symbol, size, width = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((len(checkpoints), STEP), np.uint32)
    at = checkpoints.astype(np.int64)
    mask, last = (1 << width) - 1, len(ahead) - 1
    for k in range(min(STEP, n)):
        look = (ahead[np.minimum(at >> 3, last)] >> (32 - width - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = symbol[look]
        at = at + size[look]
    return out.reshape(-1)[:n]


def tokenise(docs: DataFrame, id_col: str, text_col: str, tokenizer_json: str, end_id: int) -> DataFrame:
    """Ids of each document, encoded where its text is read; 16-bit ones as such."""
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from textloom.llm.tokens import batches, encoder

        enc = encoder(shipped.value)
        for frame in frames:
            ids = iter(frame["id"].tolist())
            for texts in batches(frame["text"].tolist()):
                rows = []
                for got in enc.encode(texts):
                    got = np.append(got, np.uint32(end_id)).astype("<u4")
                    rows.append((next(ids), len(got), (got.astype("<u2") if got.max() < 1 << 16 else got).tobytes()))
                yield pd.DataFrame(rows, columns=["id", "n", "ids"])

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, IDS)


def unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def count_ids(ids: DataFrame) -> dict[int, int]:
    """Counts over the whole corpus; as many rows as the vocabulary has ids at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1, np.int64)
        for frame in frames:
            if len(frame):
                got = np.bincount(np.concatenate([unpack(r, n) for r, n in zip(frame["ids"], frame["n"], strict=True)]))
                size = max(len(got), len(total))
                total = np.pad(total, (0, size - len(total))) + np.pad(got, (0, size - len(got)))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"t": at, "c": total[at]})

    return {r[0]: r[1] for r in ids.select("n", "ids").mapInPandas(run, "t long, c long").groupBy("t").agg(F.sum("c")).collect()}


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, max_bits: int = 16, parts: int | None = None) -> None:
    """Writes the blocks, the code lengths and the parts' starts under `path` (any Hadoop path).

    A null text is empty and has end_id alone. Rows that repeat an id lie next to
    each other. Null ids come first. An empty table writes no blocks.
    """
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ids = materialise(tokenise(docs, id_col, text_col, tokenizer_json, end_id), "ids")
    counted = count_ids(ids)
    counts = np.zeros(max(counted, default=0) + 1, np.int64)
    for t, c in counted.items():
        counts[t] = c
    lengths = code_lengths(counts, max_bits)
    shipped = spark.sparkContext.broadcast(lengths)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        size, part = shipped.value, TaskContext.get().partitionId()
        of = codes(size)
        held: list[tuple] = []
        number = at = n = 0

        def block() -> pd.DataFrame:
            symbols = np.concatenate([unpack(raw, many) for _, many, raw in held])
            bits, checkpoints = encode_block(symbols, of, size)
            ids, sizes = (np.array([r[k] for r in held], "<i8") for k in (0, 1))
            starts = at - n + np.cumsum(sizes) - sizes
            row = (part, number, ids.tobytes(), starts.astype("<i8").tobytes(), sizes.tobytes(), checkpoints.tobytes(), len(symbols), bits)
            held.clear()
            return pd.DataFrame([row], columns=["part", "block", "doc_ids", "doc_starts", "doc_lengths", "checkpoints", "n", "bits"])

        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                held.append(row)
                at, n = at + row[1], n + row[1]
                if n >= BLOCK:
                    yield block()
                    number, n = number + 1, 0
        if held:
            yield block()

    ids.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInPandas(run, BLOCKS).write.parquet(f"{path}/blocks")
    starts, at = [], 0
    for part, n in sorted(spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n")).collect()):
        starts.append((part, at))
        at += n
    spark.createDataFrame(starts, "part long, start long").coalesce(1).write.parquet(f"{path}/parts")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    forget(ids)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document from the files alone: id, start, n_tokens, ids_crc32."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()[0], np.uint8)
    shipped = spark.sparkContext.broadcast(lengths)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(shipped.value)
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = decode_block(r.bits, np.frombuffer(r.checkpoints, "<u4"), r.n, table).astype("<u4")
                docs, starts, sizes = (np.frombuffer(x, "<i8") for x in (r.doc_ids, r.doc_starts, r.doc_lengths))
                ends = np.cumsum(sizes)
                yield pd.DataFrame({"part": r.part, "id": docs, "part_start": starts, "n": sizes, "crc": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]})

    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInPandas(run, "part long, id long, part_start long, n long, crc long")
    parts = spark.read.schema("part long, start long").parquet(f"{path}/parts")
    return rows.join(F.broadcast(parts), "part").select(F.nullif("id", F.lit(NO_ID)).alias("id"), (F.col("part_start") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes into the shared folder and reads back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_json, id_col, text_col, **options)
    return read_tokens(docs.sparkSession, path).withColumnRenamed("id", id_col)
