"""One JSON array in one file, read by many tasks.

A file is cut into chunks of bytes. Whether a chunk begins inside a string, behind
a backslash, or at which depth of brackets is not known beforehand, so a first
pass says for each of the three ways to begin how the chunk would end; these are
put together in order, a few numbers for each chunk. In the second pass each chunk
gives the elements that begin in it and reads on for the end of its last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ways for a chunk to begin: outside a string, in one, in one behind a backslash.
OUT, IN, ESCAPED = range(3)
MORE = 1 << 16


def opened(path: str):
    """(file system, path in it) of any store that pyarrow knows; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def scan(data: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(signs, what each does to the depth, the way the next chunk begins): brackets and commas outside strings.

    A sign is an index into data; its step is 1 or -1 for a bracket, 0 for a comma.
    """
    at = np.arange(len(data))
    slash = data == 0x5C
    last = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at  # the last other byte up to each place
    run = at - last  # backslashes that end at each place
    run = np.where((last < 0) & (start == ESCAPED), run + 1, run)  # the one before the chunk
    before = np.r_[int(start == ESCAPED), run[:-1]] if len(data) else run
    quote = (data == 0x22) & (before % 2 == 0)
    inside = (np.cumsum(quote) + (start != OUT)) % 2 == 1
    outside = ~inside & ~quote
    step = ((data == 0x5B) | (data == 0x7B)).astype(np.int64) - ((data == 0x5D) | (data == 0x7D))
    sign = np.flatnonzero(outside & ((step != 0) | (data == 0x2C)))
    if len(data) == 0:
        return sign, step[sign], start
    ends_in = bool(inside[-1])
    return sign, step[sign], (ESCAPED if run[-1] % 2 else IN) if ends_in else OUT


def outcomes(chunks: DataFrame) -> DataFrame:
    """For each chunk and way to begin: how it ends, and by how much the depth changes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, start, size in zip(frame["path"], frame["start"].tolist(), frame["size"].tolist(), strict=True):
                store, name = opened(path)
                with store.open_input_file(name) as f:
                    data = np.frombuffer(f.read_at(size, start), np.uint8)
                for way in (OUT, IN, ESCAPED):
                    _, steps, end = scan(data, way)
                    out.append((path, start, way, end, int(steps.sum())))
            yield pd.DataFrame(out, columns=["path", "start", "way", "end", "change"])

    return chunks.mapInPandas(run, "path string, start long, way int, end int, change long")


def elements(chunks: DataFrame) -> DataFrame:
    """(path, at, value): text and byte position of each element that begins in a chunk (path, start, size, way, depth)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, size, way, depth in zip(frame["path"], *(frame[c].tolist() for c in ("start", "size", "way", "depth")), strict=True):
                store, name = opened(path)
                with store.open_input_file(name) as f:
                    yield from owned(f, path, start, size, way, depth)

    return chunks.mapInPandas(run, "path string, at long, value string")


def owned(f, path: str, start: int, size: int, way: int, depth: int) -> Iterator[pd.DataFrame]:
    raw = f.read_at(size, start)
    signs, steps, way = scan(np.frombuffer(raw, np.uint8), way)
    depths = depth + np.cumsum(steps)  # behind each sign
    marks = borders(signs, steps, depths)
    if not len(marks) or f.size() == 0:
        return
    parts, level, end, total = [raw], int(depths[-1]) if len(depths) else depth, start + size, size
    open_ = level >= 1 and raw[marks[-1] : marks[-1] + 1] != b"]"  # the last element's end lies further on
    while open_ and end < f.size():
        more = f.read_at(MORE, end)
        signs, steps, way = scan(np.frombuffer(more, np.uint8), way)
        depths = level + np.cumsum(steps)
        ended = borders(signs, steps, depths)
        parts.append(more)
        if len(ended):
            marks = np.append(marks, total + ended[0])
            break
        level = int(depths[-1]) if len(depths) else level
        end, total = end + len(more), total + len(more)
    data = b"".join(parts)
    out = []
    for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
        if data[a : a + 1] != b"]" and (value := data[a + 1 : b].strip()):
            out.append((path, start + a + 1, value.decode("utf-8")))
    if out:
        yield pd.DataFrame(out, columns=["path", "at", "value"])


def borders(signs: np.ndarray, steps: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Places between elements: the array's brackets and the commas right inside it."""
    return signs[((steps == 0) & (depths == 1)) | ((steps == 1) & (depths == 1)) | ((steps == -1) & (depths == 0))]


def read_json_array(spark: SparkSession, paths: list[str], schema: str | StructType | None = None, chunk: int = 64 << 20) -> DataFrame:
    """Elements of files that hold one JSON array each (UTF-8): columns of `schema`, or (path, at, value) with each element's text.

    An element that doesn't fit the schema gives nulls, as from_json does. Files
    with nothing or an empty array give no rows; one whose brackets don't close is
    an error. A chunk is one task; the driver holds three small rows for each.
    """
    rows = []
    for path in paths:
        store, name = opened(path)
        size = store.get_file_info(name).size
        if size is None:
            raise FileNotFoundError(path)
        rows += [(path, at, min(chunk, size - at)) for at in range(0, size, chunk)]
    if not rows:
        found = spark.createDataFrame([], "path string, at long, value string")
    else:
        spread = lambda frame: frame.repartition(len(rows), "path", "start")
        chunks = spark.createDataFrame(rows, "path string, start long, size long")
        said = {(r["path"], r["start"], r["way"]): (r["end"], r["change"]) for r in outcomes(spread(chunks)).collect()}
        known, state = [], {p: (OUT, 0) for p in paths}
        for path, at, size in rows:
            way, depth = state[path]
            known.append((path, at, size, way, depth))
            end, change = said[path, at, way]
            state[path] = end, depth + change
        if broken := [p for p, (way, depth) in state.items() if (way, depth) != (OUT, 0)]:
            raise ValueError(f"no whole JSON array: {', '.join(broken)}")
        found = elements(spread(spark.createDataFrame(known, "path string, start long, size long, way int, depth long")))
    if schema is None:
        return found
    kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    return found.select(F.from_json("value", kind).alias("e")).select("e.*")


def stream_elements(path: str) -> Iterator[object]:
    """Elements one after another, for a file that one machine reads."""
    store, name = opened(path)
    with store.open_input_file(name) as f:
        if f.size():
            for frame in owned(f, path, 0, f.size(), OUT, 0):
                yield from map(json.loads, frame["value"])
