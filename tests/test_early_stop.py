"""The stateful stream against a plain loop, over restarts from its checkpoint."""

import datetime as dt

import pytest

from textloom.streaming import early_stop

T0 = dt.datetime(2024, 1, 1)


def rows(*given):
    return [(run, step, score, T0 + dt.timedelta(minutes=m)) for run, step, score, m in given]


BATCHES = [
    rows(("a", 1, 0.5, 0), ("a", 2, 0.4, 1), ("b", 1, 0.1, 1), ("c", 1, None, 2)),
    rows(("a", 3, 0.6, 3), ("a", 4, 0.6, 4), ("b", 2, 0.2, 4), ("c", 2, 0.3, 5)),
    rows(("a", 5, 0.1, 6), ("a", 6, 0.9, 7), ("b", 3, 0.1, 7), ("c", 3, 0.2, 8)),  # a stops at step 5 and passes over 6
    rows(("b", 4, 0.05, 400)),  # hours later: b stops, and a and c become idle
    rows(("d", 1, 0.7, 800)),
    rows(("a", 7, 0.2, 801), ("d", 2, 0.8, 802)),  # a starts anew
]
WANT = {
    ("a", 1, 0.5, "best"), ("a", 3, 0.6, "best"), ("a", 5, 0.6, "stopped"), ("b", 1, 0.1, "best"), ("b", 2, 0.2, "best"), ("b", 4, 0.2, "stopped"), ("c", 2, 0.3, "best"),
    ("a", 3, 0.6, "expired"), ("c", 2, 0.3, "expired"), ("b", 2, 0.2, "expired"), ("d", 1, 0.7, "best"), ("a", 7, 0.2, "best"), ("d", 2, 0.8, "best"),
}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", early_stop.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("restarts", [True, False])
def test_early_stop(rocks, tmp_path, restarts):
    """One file a batch; with restarts the query ends after each and goes on from its checkpoint."""
    kind = "run_id string, step long, score double, ts timestamp"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = rocks.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        early_stop.run_early_stop(stream, out, checkpoint, patience=2, idle="1 hour", late="0 seconds").awaitTermination()

    for k, batch in enumerate(BATCHES):
        rocks.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        if restarts or k == len(BATCHES) - 1:
            run()
    got = [tuple(r) for r in rocks.read.schema(early_stop.OUTPUT).parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == WANT
    run()
    assert rocks.read.schema(early_stop.OUTPUT).parquet(out).count() == len(got)
