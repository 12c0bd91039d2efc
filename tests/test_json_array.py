"""A JSON array in chunks of any size against json.load."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.sources import json_array

TRICKY = [
    {"a": 'quote " and \\ and \\\\" end', "b": [1, [2, {"c": "]},{["}]], "d": {"e": "x\\"}},
    {"a": "\\" * 7, "b": [], "d": None}, {"a": '",[', "b": [[], {}]}, {"a": "é日本   \t\n", "b": [1.5, True, None]}, {},
]


def texts(name):
    rng = random.Random(name)
    word = lambda: "".join(rng.choice('ab"\\[]{},: é\n') for _ in range(rng.randrange(12)))
    some = TRICKY + [{"a": word(), "b": [word() for _ in range(rng.randrange(3))], "n": k} for k in range(60)]
    return {"compact": json.dumps(some, separators=(",", ":")), "pretty": json.dumps(some, indent=2, ensure_ascii=False), "mixed": '\n [ 1,"two" , [3], {"four": "]"},null , true,-2.5e3 ] \n', "empty": " [ ] ", "nothing": "", "strings": json.dumps([word() for _ in range(200)])}[name]


@pytest.mark.parametrize("name", ["compact", "pretty", "mixed", "empty", "nothing", "strings"])
def test_any_chunk_gives_the_same(tmp_path, name):
    """Borders inside strings, escapes, characters and brackets; without Spark, the two passes by hand."""
    path = str(tmp_path / "x.json")
    raw = texts(name).encode()
    (tmp_path / "x.json").write_bytes(raw)
    want = json.loads(raw) if raw.strip() else []
    for chunk in [*range(1, 40), 97, 1000, 10**6]:
        import numpy as np

        way, depth, got = json_array.OUT, 0, []
        store, file = json_array.opened(path)
        with store.open_input_file(file) as f:
            for at in range(0, len(raw), chunk):
                size = min(chunk, len(raw) - at)
                for frame in json_array.owned(f, path, at, size, way, depth):
                    got += [json.loads(v) for v in frame["value"]]
                    assert all(raw[p:].lstrip().startswith(v.encode()) for p, v in zip(frame["at"], frame["value"], strict=True))
                _, steps, way = json_array.scan(np.frombuffer(raw[at : at + size], np.uint8), way)
                depth += int(steps.sum())
        assert got == want, chunk
    assert list(json_array.stream_elements(path)) == want


def test_spark(spark, tmp_path):
    paths, want = [], []
    for name in ("compact", "pretty", "empty", "nothing"):
        (tmp_path / f"{name}.json").write_text(texts(name), encoding="utf-8")
        paths.append(str(tmp_path / f"{name}.json"))
        want += json.loads(texts(name)) if texts(name) else []
    got = json_array.read_json_array(spark, paths, chunk=500)
    assert got.rdd.getNumPartitions() > 10
    order = lambda xs: sorted(json.dumps(x, sort_keys=True) for x in xs)
    assert order(json.loads(r["value"]) for r in got.collect()) == order(want)
    one = [json.loads(r["value"]) for r in got.filter(F.col("path") == paths[1]).orderBy("at").collect()]
    assert one == json.loads(texts("pretty"))
    typed = json_array.read_json_array(spark, [f"file://{paths[0]}"], "a string, n int", chunk=333)
    assert order([r["a"], r["n"]] for r in typed.collect()) == order([x.get("a"), x.get("n")] for x in json.loads(texts("compact")))
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": ')
    with pytest.raises(ValueError, match="cut.json"):
        json_array.read_json_array(spark, [str(tmp_path / "cut.json")], chunk=5)
    with pytest.raises(FileNotFoundError):
        json_array.read_json_array(spark, [str(tmp_path / "none.json")])
    assert json_array.read_json_array(spark, []).count() == 0


def test_read_source(spark, tmp_path):
    from textloom.sources.files import read_source

    path = str(tmp_path / "news.json")
    (tmp_path / "news.json").write_text(json.dumps([{"Headline": f"h{k}", "source_id": str(k)} for k in range(9)]))
    got = read_source(spark, path, "news", schema="Headline string, source_id string")
    assert sorted(map(tuple, got.collect())) == [(f"h{k}", str(k)) for k in range(9)] and got.columns == ["title", "source_id"]
    placed = read_source(spark, path, "news", schema="Headline string").collect()
    assert [r["title"] for r in sorted(placed, key=lambda r: int(r["source_id"]))] == [f"h{k}" for k in range(9)]
