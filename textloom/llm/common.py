"""Shared pieces of the training-data operators: inputs, shared storage, hashing."""

from __future__ import annotations

import contextlib
import json
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is missing, a temporary folder is made and remembered in
    the session, but only for a local master: on a cluster each machine would
    write to its own disk, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("textloom.shared.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("textloom.shared.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/textloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back.

    A lost executor then costs one re-read and no re-computation.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.textloom_path = path  # type: ignore[attr-defined]
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def forget(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing reads it any more."""
    if path := getattr(df, "textloom_path", None):
        delete(df.sparkSession, path)


def forget_all(spark: SparkSession, *but: DataFrame) -> None:
    """Deletes all that the operators wrote in this session, save for these frames; results not yet read are lost."""
    for path in _written - {getattr(df, "textloom_path", None) for df in but}:
        delete(spark, path)


def text_of(col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_hash(id_col: str, text_col: str = "text") -> Column:
    """A hash of id and text, to tell rows apart that repeat an id or have none."""
    return F.xxhash64(F.col(id_col), text_of(text_col))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose (id, row_hash) is not in gone; texts of other rows than these, or nearly so, aren't shuffled."""
    gone = materialise(gone.select(F.col(id_col).alias("_gone"), F.col("row_hash").alias("_hash")).distinct(), "gone")
    bits = min(26, max(12, (16 * gone.count()).bit_length()))
    met = might_contain(bit_filter(gone.select("_hash"), "_hash", bits).scalar(), row_hash(id_col, text_col), bits)
    near = docs.filter(met)
    same = (row_hash(id_col, text_col) == F.col("_hash")) & F.col(id_col).eqNullSafe(F.col("_gone"))
    return docs.filter(~met).unionByName(near.join(gone, same, "left_anti"))


def repeated_ids(rows: DataFrame, id_col: str, log2_bits: int = 22) -> Column:
    """Whether a row's id may be one that several rows have: true for all of these, rarely for others, true for null."""
    many = materialise(rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id"), "repeated")
    return F.coalesce(might_contain(bit_filter(many, "_id", log2_bits).scalar(), F.col(id_col), log2_bits), F.lit(True))


def bit_words(keys: DataFrame, key: str, log2_bits: int) -> DataFrame:
    slot = F.pmod(F.col(key), F.lit(1 << log2_bits))
    return keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("bits"))


def bit_filter(keys: DataFrame, key: str, log2_bits: int = 20) -> DataFrame:
    """One row, one column `words`: a bitmap of 2**log2_bits bits over a bigint column.

    Its size is fixed by log2_bits, never by the data, so it can go to every task.
    Too many keys only make it less selective.
    """
    return (
        keys.sparkSession.range(1 << (log2_bits - 6)).withColumnRenamed("id", "w").join(bit_words(keys, key, log2_bits), "w", "left")
        .agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
        .select(F.col("all.bits").alias("words"))
    )


def bit_literal(keys: DataFrame, key: str, log2_bits: int) -> Column:
    """bit_filter() as a constant, for use inside higher-order functions, where Spark takes no subquery."""
    words = [0] * (1 << (log2_bits - 6))
    for w, bits in bit_words(keys, key, log2_bits).collect():
        words[w] = bits
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def might_contain(words: Column, key: Column, log2_bits: int = 20) -> Column:
    """False only if key is certainly not among the keys of bit_filter()."""
    slot = F.pmod(key, F.lit(1 << log2_bits))
    return F.getbit(F.get(words, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, by: list[str], per: int = 1024) -> DataFrame:
    """Inner join on keys where the rows of a hot key go to several tasks.

    small has one row for each key and, in column `rows`, how many rows of big
    have it; it is read several times, so it should be materialised. Keys of over
    `per` rows (and of over a 1024th of the hottest) are marked in a bitmap of
    fixed size. Rows of big with a marked key are dealt by the columns `by` over
    salts, and small's row of it is repeated for each salt. Without a hot key it
    is a plain join. Null keys join with nothing.
    """
    most = small.agg(F.max(rows)).first()[0] or 0
    salts = min(1024, -(-most // per))
    if salts < 2:
        return big.join(small, keys)
    digest = F.xxhash64(*keys)
    hot = bit_filter(small.filter(F.col(rows) > max(per, most // 1024)).select(digest.alias("h")), "h", 20).scalar()
    dealt = F.when(might_contain(hot, digest, 20), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(might_contain(hot, digest, 20), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("_salt", dealt).join(small.withColumn("_salt", F.explode(every)), [*keys, "_salt"]).drop("_salt")


def give_back() -> None:
    """Returns freed memory to the system at a task's end: idle workers of one stage stand beside those of the next."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class SpanHasher:
    """Hashes of any byte spans of a buffer from one prefix sum (polynomial, modulo 2**64).

    Bytes are first mapped through a table of random odd 64-bit values, so equal
    spans get equal hashes wherever they lie and different ones all but never do.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        self.value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.power):
            with np.errstate(over="ignore"):
                size = 1 << (n - 1).bit_length()
                base = np.full(size, MULTIPLIER, np.uint64)
                base[0] = 1
                self.power = np.multiply.accumulate(base)
                base = np.full(size, INVERSE, np.uint64)
                base[0] = 1
                self.inverse = np.multiply.accumulate(base)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self.grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.value[data] * self.power[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.grow(len(prefix))
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def union_find(pairs_a: np.ndarray, pairs_b: np.ndarray) -> dict[int, int]:
    """Smallest member of the component of every id (for small, local sets)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}
