"""Queries of continuity, windows and runs (W-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import continuity as c
from roadlens.operators import rolling as r
from roadlens.plans.registry import query
from roadlens.plans.sql import BLK, KEYS, SEG, blocks, runs, valid_sql, with_irregular, with_ticks
from roadlens.sources.adapters import irregular, ticks


def rpm_blocks(spark, sf_dir, *signals):
    return c.local_blocks(ticks(spark, sf_dir), c.quality_valid(signals or ("rpm",)))


@query(
    with_ticks(
        blocks("rpm"),
        """seg AS (SELECT trip_id, segment_id, min(t) AS ft, max(coalesce(block, 0)) AS n FROM blk GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (ORDER BY ft, trip_id, segment_id) - n AS off, lag(trip_id) OVER (ORDER BY ft, trip_id, segment_id) AS tb FROM seg)""",
    )
    + f"""SELECT {KEYS}, ok AS valid, cont AS continues,
 CASE WHEN NOT ok THEN 'invalid_sample' WHEN cont THEN 'continuous' WHEN p_ok IS NULL AND tb IS NULL THEN 'dataset_start'
 WHEN p_ok IS NULL AND tb <> trip_id THEN 'trip_boundary' WHEN p_ok IS NULL THEN 'segment_boundary' WHEN NOT p_ok THEN 'previous_sample_invalid'
 WHEN row_in_segment - p_r <> 1 THEN 'row_not_consecutive' ELSE 'timestamp_not_consecutive' END AS break_reason,
 CAST(block + off AS BIGINT) AS block_id FROM blk JOIN o USING (trip_id, segment_id)"""
)
def w01_continuity(spark, sf_dir):
    return c.continuity(ticks(spark, sf_dir), c.quality_valid(["rpm"]))


@query(
    with_ticks(blocks("rpm"))
    + f"""SELECT {KEYS}, block IS NOT NULL AND row_number() OVER ({BLK}) >= 30 AS strict_window,
 block IS NOT NULL AND coalesce(t - lag(t, 20) OVER ({BLK}) = 20, FALSE) AS strict_span,
 block IS NOT NULL AND lag(t, 1) OVER ({BLK}) IS NOT NULL AND lead(t, 2) OVER ({BLK}) IS NOT NULL AS neighbourhood FROM blk"""
)
def w02_w03_w04_admission(spark, sf_dir):
    df = rpm_blocks(spark, sf_dir)
    return df.select(*c.KEYS, c.strict_window(30).alias("strict_window"), c.strict_span(20).alias("strict_span"), c.neighbourhood(1, 2).alias("neighbourhood"))


@query(with_ticks(blocks("maf"), runs("maf = 0")) + f"SELECT {KEYS}, block, run FROM run_t WHERE run IS NOT NULL")
def w05_true_runs(spark, sf_dir):
    return c.true_runs(rpm_blocks(spark, sf_dir, "maf"), F.col("maf") == 0).where("run is not null").select(*c.KEYS, "block", "run")


@query(
    with_ticks(blocks("maf"), runs("maf = 0"))
    + f"SELECT {KEYS}, run IS NOT NULL AND row_number() OVER (PARTITION BY trip_id, segment_id, block, run ORDER BY row_in_segment) >= 5 AS persists FROM run_t"
)
def w06_persistence(spark, sf_dir):
    return c.persistence(rpm_blocks(spark, sf_dir, "maf"), F.col("maf") == 0, 5).select(*c.KEYS, "persists")


@query(
    with_irregular("""g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY trip_id ORDER BY us, event_id) > 21600000000 THEN 1 ELSE 0 END AS b FROM irregular)""")
    + "SELECT event_id, trip_id, CAST(sum(b) OVER (PARTITION BY trip_id ORDER BY us, event_id) + 1 AS BIGINT) AS segment FROM g"
)
def w07_segment_by_gap(spark, sf_dir):
    return c.segment_by_gap(irregular(spark, sf_dir), 6 * 3600.0).select("event_id", "trip_id", "segment")


@query(
    with_ticks("s AS (SELECT trip_id, segment_id, min(t) AS start, max(t) AS stop FROM ticks GROUP BY ALL)")
    + """SELECT trip_id, segment_id, CASE WHEN g >= 0 THEN CAST(g AS DOUBLE) END AS gap_seconds
FROM (SELECT *, start - lag(stop) OVER (ORDER BY start, trip_id, segment_id) AS g FROM s)"""
)
def w10_segment_gap(spark, sf_dir):
    return r.segment_gaps(ticks(spark, sf_dir))


@query(
    with_ticks(blocks("rpm"))
    + f"""SELECT {KEYS}, round(CASE WHEN block IS NOT NULL THEN (rpm - lag(rpm) OVER ({BLK})) / (t - lag(t) OVER ({BLK})) END, 6) AS rpm_slope FROM blk"""
)
def w11_slope(spark, sf_dir):
    return rpm_blocks(spark, sf_dir).select(*c.KEYS, F.round(r.slope("rpm"), 6).alias("rpm_slope"))


_W = lambda n: f"({BLK} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    with_ticks(blocks("map"))
    + f"""SELECT {KEYS}, round(CASE WHEN block IS NOT NULL AND count(*) OVER {_W(30)} = 30 THEN stddev_samp(map) OVER {_W(30)} END, 5) AS std_30,
 round(CASE WHEN block IS NOT NULL AND count(*) OVER {_W(20)} = 20 THEN max(map) OVER {_W(20)} - min(map) OVER {_W(20)} END, 6) AS range_20 FROM blk"""
)
def w12_w13_rolling(spark, sf_dir):
    df = rpm_blocks(spark, sf_dir, "map")
    return df.select(*c.KEYS, F.round(r.rolling_std("map", 30), 5).alias("std_30"), F.round(r.rolling_range("map", 20), 6).alias("range_20"))


@query(
    with_ticks(blocks("coolant_temp"))
    + f"""SELECT {KEYS}, round(CASE WHEN block IS NOT NULL AND t - lag(t, 15) OVER ({BLK}) = 15 THEN sum(coolant_temp) OVER {_W(16)} - (coolant_temp + lag(coolant_temp, 15) OVER ({BLK})) / 2 END, 6) AS integral_15,
 round(CASE WHEN block IS NOT NULL AND t - lag(t, 15) OVER ({BLK}) = 15 THEN (coolant_temp - lag(coolant_temp, 15) OVER ({BLK})) / 0.25 END, 6) AS rate_15 FROM blk"""
)
def w14_w15_span(spark, sf_dir):
    df = rpm_blocks(spark, sf_dir, "coolant_temp")
    return df.select(*c.KEYS, F.round(r.trapezoid("coolant_temp", 15), 6).alias("integral_15"), F.round(r.span_rate("coolant_temp", 15), 6).alias("rate_15"))


@query(with_ticks(blocks("rpm")) + f"SELECT {KEYS} FROM (SELECT *, lag(rpm >= 50) OVER ({BLK}) AS p FROM blk) WHERE block IS NOT NULL AND rpm >= 50 AND p = FALSE")
def w16_rising_edge(spark, sf_dir):
    df = rpm_blocks(spark, sf_dir)
    return df.withColumn("edge", c.rising_edge(F.col("rpm") >= 50)).where("edge").select(*c.KEYS)


@query(
    with_ticks(f"d AS (SELECT *, t - lag(t) OVER ({SEG}) AS d FROM ticks)", "e AS (SELECT *, CAST(CASE WHEN d > 0 AND d <= 5 THEN d ELSE 1 END AS DOUBLE) AS dt FROM d)")
    + f"""SELECT {KEYS}, dt, round(avg(speed) OVER ({SEG} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth,
 round(coalesce((speed - lag(speed) OVER ({SEG})) / 3.6 / dt, 0), 6) AS accel,
 round(sum(CASE WHEN rpm >= 50 THEN coalesce(maf, 0) * dt ELSE 0 END) OVER ({SEG}), 4) AS air_mass,
 max(CASE WHEN coalesce(coolant_temp >= 75, FALSE) THEN 1 ELSE 0 END) OVER ({SEG}) = 1 AS warm,
 last_value(maf IGNORE NULLS) OVER ({SEG}) AS maf_filled FROM e"""
)
def w18_to_w22_segment_windows(spark, sf_dir):
    df = ticks(spark, sf_dir).withColumn("dt", r.step_seconds())
    accel = (F.col("speed") - F.lag("speed").over(c.segment_window())) / 3.6 / F.col("dt")
    return df.select(
        *c.KEYS,
        "dt",
        F.round(r.centred_mean("speed"), 6).alias("smooth"),
        F.round(F.coalesce(accel, F.lit(0.0)), 6).alias("accel"),
        F.round(r.running_sum(F.when(F.col("rpm") >= 50, F.col("maf") * F.col("dt"))), 4).alias("air_mass"),
        r.latch(F.col("coolant_temp") >= 75).alias("warm"),
        r.forward_fill("maf").alias("maf_filled"),
    )


@query(
    with_ticks(f"o AS (SELECT *, CAST(sum(CASE WHEN coalesce(maf = 0, FALSE) THEN 0 ELSE 1 END) OVER ({SEG}) AS BIGINT) AS o FROM ticks WHERE child_state <> 'idle')")
    + """SELECT trip_id, segment_id, coalesce(max(n), 0) AS longest FROM (SELECT trip_id, segment_id, o, count(*) FILTER (maf = 0) AS n FROM o GROUP BY ALL) GROUP BY ALL"""
)
def w24_longest_run(spark, sf_dir):
    return c.longest_runs(ticks(spark, sf_dir).where("child_state <> 'idle'"), F.col("maf") == 0)


@query(
    with_ticks("n AS (SELECT *, row_number() OVER (PARTITION BY trip_id, segment_id ORDER BY row_in_segment) - 1 AS i FROM ticks)", "w AS (SELECT *, CAST(floor(i / 512) AS INTEGER) AS window_no, CAST(i % 512 AS INTEGER) AS step FROM n)")
    + f"SELECT {KEYS}, window_no, step FROM (SELECT *, count(*) OVER (PARTITION BY trip_id, segment_id, window_no) AS k FROM w) WHERE k = 512"
)
def w29_tumble_rows(spark, sf_dir):
    return r.tumble_rows(ticks(spark, sf_dir), 512).select(*c.KEYS, "window_no", "step")


@query(
    with_ticks(
        f"""s AS (SELECT trip_id, segment_id, row_number() OVER ({SEG}) - 1 AS start, count(*) OVER w AS n, count(maf) OVER w AS observed, avg(maf) OVER w AS m FROM ticks
WINDOW w AS ({SEG} ROWS BETWEEN CURRENT ROW AND 127 FOLLOWING))"""
    )
    + "SELECT trip_id, segment_id, CAST(start AS INTEGER) AS start, observed, round(m, 6) AS mean FROM s WHERE n = 128 AND start % 64 = 0"
)
def w30_slide_rows(spark, sf_dir):
    return r.slide_rows(ticks(spark, sf_dir), 128, 64, "maf").withColumn("mean", F.round("mean", 6))


@query(
    with_ticks(
        f"""i AS (SELECT *, last_value(maf IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN maf IS NOT NULL THEN row_in_segment END IGNORE NULLS) OVER b AS r0,
 first_value(maf IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN maf IS NOT NULL THEN row_in_segment END IGNORE NULLS) OVER f AS r1 FROM ticks
 WINDOW b AS ({SEG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({SEG} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
    )
    + f"SELECT {KEYS}, round(coalesce(maf, CASE WHEN r1 > r0 THEN v0 + (v1 - v0) * (row_in_segment - r0) / (r1 - r0) END, v0, v1), 6) AS maf FROM i"
)
def w31_interpolate_both(spark, sf_dir):
    return ticks(spark, sf_dir).select(*c.KEYS, F.round(r.interpolate_both("maf"), 6).alias("maf"))


@query(
    with_ticks("n AS (SELECT *, CAST(floor((row_in_segment - 1) / 128) AS BIGINT) AS w FROM ticks WHERE rpm IS NOT NULL)")
    + f"SELECT {KEYS}, round((rpm - avg(rpm) OVER p) / CASE WHEN stddev_pop(rpm) OVER p < 1e-6 THEN 1 ELSE stddev_pop(rpm) OVER p END, 5) AS z FROM n WINDOW p AS (PARTITION BY trip_id, segment_id, w)"
)
def w32_zscore_window(spark, sf_dir):
    df = ticks(spark, sf_dir).where("rpm is not null").withColumn("w", F.floor((F.col("row_in_segment") - 1) / 128))
    return r.zscores(df, "rpm", ("trip_id", "segment_id", "w")).select(*c.KEYS, F.round("z", 5).alias("z"))


@query(
    with_ticks(
        blocks("maf"),
        runs("maf = 0"),
        "g AS (SELECT trip_id, segment_id, block, run, min(row_in_segment) AS first_row, min(t) AS ft, count(*) AS n FROM run_t WHERE run IS NOT NULL GROUP BY ALL)",
    )
    + "SELECT trip_id, segment_id, first_row, n FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ft, segment_id) AS k FROM g WHERE n >= 6) WHERE k = 1"
)
def w33_first_window(spark, sf_dir):
    return c.first_window(rpm_blocks(spark, sf_dir, "maf"), F.col("maf") == 0, 6)


@query(
    with_ticks(
        "s AS (SELECT trip_id, segment_id, min(t) AS ft, max(t) - min(t) AS d FROM ticks GROUP BY ALL)",
        "o AS (SELECT *, sum(d) OVER (PARTITION BY trip_id ORDER BY ft, segment_id) - d AS off FROM s)",
    )
    + f"SELECT {KEYS}, CAST(t - ft + off AS BIGINT) AS driving_seconds FROM ticks JOIN o USING (trip_id, segment_id)"
)
def w35_compressed_time(spark, sf_dir):
    from pyspark.sql import Window

    df = ticks(spark, sf_dir)
    s = df.groupBy("trip_id", "segment_id").agg(F.min("t").alias("ft"), (F.max("t") - F.min("t")).alias("d"))
    s = s.withColumn("off", F.sum("d").over(Window.partitionBy("trip_id").orderBy("ft", "segment_id")) - F.col("d"))
    return df.join(s, ["trip_id", "segment_id"]).select(*c.KEYS, (F.col("t") - F.col("ft") + F.col("off")).alias("driving_seconds"))


@query(with_ticks() + f"SELECT {KEYS}, coalesce({valid_sql('rpm', 'maf')}, FALSE) AS valid FROM ticks")
def p05_quality_valid(spark, sf_dir):
    return ticks(spark, sf_dir).select(*c.KEYS, c.quality_valid(["rpm", "maf"]).alias("valid"))


@query(
    with_ticks(f"s AS (SELECT *, CAST(count(maf) OVER ({SEG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seen FROM ticks)", "g AS (SELECT trip_id, segment_id, seen, count(*) AS n FROM s WHERE maf IS NULL GROUP BY ALL)")
    + "SELECT trip_id, segment_id, count(*) AS runs, max(n) AS longest FROM g GROUP BY ALL"
)
def a04_null_runs(spark, sf_dir):
    return r.null_runs(ticks(spark, sf_dir), "maf")
