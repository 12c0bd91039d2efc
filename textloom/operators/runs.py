"""Experiment grids that go on where they were: a run that the log has is not run again."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from textloom.sources.commits import VersionedTable

LOG = "run_id string, phase string, settings string, result string, minutes double"


def run_id(phase: str, settings: dict) -> str:
    """The same for the same settings, whatever their order."""
    return "|".join([phase, *(f"{k}={settings[k]}" for k in sorted(settings))])


def pending(grid: list[dict], log: VersionedTable, phase: str) -> list[dict]:
    """Settings of the grid, each once and in order, that have no logged run of this phase."""
    wanted = {run_id(phase, s): s for s in grid}
    rows = log.present(["run_id"])
    done = set() if rows is None else {r[0] for r in rows.filter(rows["run_id"].isin(*wanted)).select("run_id").collect()} if wanted else set()
    return [s for i, s in wanted.items() if i not in done]


def run_grid(grid: list[dict], log: VersionedTable, phase: str, fit: Callable[[dict], dict]) -> DataFrame:
    """The logged runs of the grid, after fit(settings) -> results for those that lack one.

    Each run is committed to the log when it ends, so a grid that breaks off goes
    on with the run at which it broke, and several drivers may share a log: a run
    that two of them made has the row that was committed last.
    """
    spark = log.spark
    for settings in pending(grid, log, phase):
        began = time.time()
        result = fit(settings)
        row = (run_id(phase, settings), phase, json.dumps(settings, sort_keys=True), json.dumps(result, sort_keys=True), (time.time() - began) / 60)
        log.append(spark.createDataFrame([row], LOG))
    rows = log.present(["run_id"])
    if rows is None:
        return spark.createDataFrame([], LOG)
    return rows.filter(rows["run_id"].isin(*{run_id(phase, s) for s in grid})) if grid else rows.limit(0)


def best_settings(runs: DataFrame, metric: str) -> dict:
    """Settings of the run with the highest metric; of equal ones the first by run_id. ValueError without runs."""
    rows = [(json.loads(r["result"])[metric], r["run_id"], json.loads(r["settings"])) for r in runs.collect()]  # a grid's runs
    if not rows:
        raise ValueError("no runs")
    return min(rows, key=lambda r: (-r[0], r[1]))[2]
