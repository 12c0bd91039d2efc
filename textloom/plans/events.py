"""Event windows, JSON records, resume; the batch forms of what streaming/ runs incrementally."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.plans.registry import dec, query, table
from textloom.sources import jsonl
from textloom.streaming import windows


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(value) AS DECIMAL(18,4)) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return windows.tumbling(events(spark, sf_dir), "1 hour").select("start", "event_type", "n", dec("total", 4).alias("total"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2")
def events_sliding(spark, sf_dir):
    return windows.tumbling(events(spark, sf_dir), "1 hour", "30 minutes").select("start", "event_type", "n")


@query(
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events)) GROUP BY user_id, s"
)
def events_session(spark, sf_dir):
    return windows.sessions(events(spark, sf_dir), "2 hours").select("user_id", "start", "n")


@query("SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def events_dedup(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).dropDuplicates()


@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(value) AS DECIMAL(18,4)) AS total FROM events GROUP BY 1, 2")
def progress_counters(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), dec(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, json_valid(props) AS valid, coalesce(json_valid(props) AND len(list_filter(['k', 'v'], lambda x: NOT list_contains(json_keys(props), x))) > 0, false) AS incomplete FROM events")
def jsonl_validate(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.col("props").alias("value"))
    return e.select("event_id", jsonl.is_json(F.col("value")).alias("valid"), (F.size(jsonl.missing(F.col("value"), ["k", "v"])) > 0).alias("incomplete"))


@query("SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_props(spark, sf_dir):
    return events(spark, sf_dir).select(F.explode(F.json_object_keys("props")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE))")
def resume_keys(spark, sf_dir):
    """Rows whose key (a user's day) isn't done yet: a purchase ends it."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return e.join(e.filter("event_type = 'purchase'").select("user_id", "day").distinct(), ["user_id", "day"], "left_anti").select("event_id")


@query("SELECT user_id, max(CASE WHEN event_type = 'click' THEN ts END) AS last_click, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def field_merge(spark, sf_dir):
    """A cache whose later lines overwrite fields of earlier ones."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_click"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))
