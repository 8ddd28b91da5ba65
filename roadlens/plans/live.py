"""Queries of the streaming forms (ST-*): all that a feed holds equals the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.plans.registry import query
from roadlens.sources.adapters import table
from roadlens.sources.scratch import scratch
from roadlens.streaming import live


def _feed(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    feed = live.read_feed(spark, sf_dir, schema, "events.parquet")
    return feed.select(F.col("user_id").cast("string").alias("trip_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


@query(
    "SELECT CAST(user_id AS VARCHAR) AS trip_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, count(*) AS samples FROM events GROUP BY ALL"
)
def st01_stream_resample(spark, sf_dir):
    out = live.run_now(live.stream_resample(_feed(spark, sf_dir), "1 hour", "1 hour"))
    return out.select("trip_id", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01', CAST(bin.start AS TIMESTAMP_NTZ))").alias("hour"), "value", "samples")


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM g)
SELECT CAST(user_id AS VARCHAR) AS trip_id, count(*) AS samples, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM s GROUP BY user_id, seg"""
)
def st02_stream_segments(spark, sf_dir):
    out = live.run_now(live.stream_segments(_feed(spark, sf_dir), "6 hours", "1 hour"))
    return out.select("trip_id", "samples", *[F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST({c} AS TIMESTAMP_NTZ))").alias(f"{c}_us") for c in ("first", "last")])


@query("SELECT CAST(user_id AS VARCHAR) AS trip_id, event_id % 20 AS window_id FROM events GROUP BY ALL")
def st03_foreach_append(spark, sf_dir):
    path = scratch(spark, "history")
    feed = _feed(spark, sf_dir).select("trip_id", (F.col("event_id") % 20).alias("window_id"))
    for run in range(2):  # the second run appends nothing
        q = feed.writeStream.option("checkpointLocation", scratch(spark, f"progress-{run}")).trigger(availableNow=True).foreachBatch(live.foreach_append(path)).start()
        q.awaitTermination()
    return spark.read.parquet(path)


_EARLY = """ev AS (SELECT user_id, event_id, ts, value, epoch_us(ts) AS us FROM events), md AS (SELECT min(us) + (max(us) - min(us)) // 2 AS mid, max(us) - 3600000000 AS mark FROM ev),
kept AS (SELECT ev.*, mark FROM ev, md WHERE NOT (us < mid AND event_id % 50 = 0))"""


def _arrivals(spark, sf_dir):
    """The earlier half of the events, the later half, and then, too late, every fiftieth of the earlier ones."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trip_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    us = F.unix_micros("ts")
    low, high = e.agg(F.min(us), F.max(us)).first()
    early, late = us < low + (high - low) // 2, F.col("event_id") % 50 == 0
    return [e.where(early & ~late), e.where(~early), e.where(early & late)]


_HOUR = "timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01', CAST(bin.start AS TIMESTAMP_NTZ))"


@query(
    f"""WITH {_EARLY} SELECT CAST(user_id AS VARCHAR) AS trip_id, CAST(floor(us / 3600000000) AS BIGINT) AS hour, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, count(*) AS samples
FROM kept WHERE (floor(us / 3600000000) + 1) * 3600000000 <= mark GROUP BY ALL"""
)
def st01_append_with_late_rows(spark, sf_dir):
    """Append mode over three arrivals with restarts: late rows are dropped, closed hours are given out once, open ones not yet."""
    out = live.run_arrivals(_arrivals(spark, sf_dir), lambda feed: live.stream_resample(feed, "1 hour", "1 hour"))
    return out.select("trip_id", F.expr(_HOUR).alias("hour"), "value", "samples")


@query(
    f"""WITH {_EARLY}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 21600000000 THEN 1 ELSE 0 END AS b FROM kept), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, event_id) AS seg FROM g)
SELECT CAST(user_id AS VARCHAR) AS trip_id, count(*) AS samples, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY user_id, seg HAVING max(us) + 21600000000 <= any_value(mark)"""
)
def st02_append_with_late_rows(spark, sf_dir):
    """Sessions in append mode: one that goes on over an arrival is one session, and is given out when its gap has passed."""
    out = live.run_arrivals(_arrivals(spark, sf_dir), lambda feed: live.stream_segments(feed, "6 hours", "1 hour"))
    return out.select("trip_id", "samples", *[F.unix_micros(c).alias(f"{c}_us") for c in ("first", "last")])
