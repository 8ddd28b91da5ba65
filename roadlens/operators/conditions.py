"""Operating conditions of a sample: thermal state, child state, their label, and shares of time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.functions.physics import vsp
from roadlens.operators.continuity import KEYS, segment_window
from roadlens.operators.ranks import exact_quantiles
from roadlens.operators.rolling import centred_mean, forward_fill, latch, running_sum, step_seconds


def motion(df: DataFrame) -> DataFrame:
    """``df`` with dt_seconds, speed_smooth_kmh, accel_ms2_smooth, vsp_kw_per_t and cumulative_air_mass_g."""
    df = df.withColumns({"dt_seconds": step_seconds(), "speed_smooth_kmh": centred_mean("speed")})
    accel = (F.col("speed_smooth_kmh") - F.lag("speed_smooth_kmh").over(segment_window())) / 3.6 / F.col("dt_seconds")
    first = F.lag("row_in_segment").over(segment_window()).isNull()
    df = df.withColumn("accel", F.when(first, 0.0).otherwise(accel))
    df = df.withColumn("accel_ms2_smooth", F.avg("accel").over(segment_window().rowsBetween(-1, 1)))
    on = F.col("rpm") >= k.CONDITIONS["rpm_on"]
    return df.withColumns(
        {
            "vsp_kw_per_t": vsp(F.col("speed_smooth_kmh") / 3.6, F.col("accel_ms2_smooth")),
            "cumulative_air_mass_g": running_sum(F.when(on, F.greatest(F.coalesce("maf", F.lit(0.0)), F.lit(0.0)) * F.col("dt_seconds"))),
        }
    ).drop("accel")


def thermal_state(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """``df`` (of ``motion``) with ``thermal``: engine_off, warmup, post_warmup or unknown.

    Post-warm-up is latched within a segment. It needs warm coolant and one sign more: slow idling, enough
    air taken in while moving, or warm intake air; without a coolant reading the last two will do. A
    missing engine speed takes over the state before.
    """
    m, c = k.CONDITIONS | (limits or {}), F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    on, off = yes(c("rpm") >= m["rpm_on"]), yes(c("rpm") < m["rpm_on"])
    idle = yes((c("speed_smooth_kmh") < m["moving_kmh"]) & (c("rpm") < m["hot_idle_rpm"]))
    moving = yes((c("speed_smooth_kmh") >= m["moving_kmh"]) & (c("cumulative_air_mass_g") > m["air_mass_g"]))
    soaked = yes(c("intake_temp") - c("ambient_temp") > m["iat_aat"])
    seen = latch((on & yes(c("coolant_temp") >= m["ect_warm"]) & (idle | moving | soaked)) | (on & c("coolant_temp").isNull() & (moving | soaked)))
    raw = F.when(c("rpm").isNull(), F.lit(None)).when(off, "engine_off").when(seen, "post_warmup").otherwise("warmup")
    return df.withColumn("thermal_raw", raw).withColumn("thermal", F.coalesce(forward_fill("thermal_raw"), F.lit("unknown"))).drop("thermal_raw")


def child_state(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """``df`` with ``child_raw``: idle, high_load, acceleration, deceleration or steady_driving before smoothing; filled over missing speed or rpm."""
    m, c = k.CONDITIONS | (limits or {}), F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    v, a, band = c("speed_smooth_kmh"), c("accel_ms2_smooth"), m["accel_band"]
    moving = yes(v >= m["moving_kmh"])
    raw = (
        F.when(c("speed").isNull() | c("rpm").isNull(), F.lit(None))
        .when(c("thermal") == "engine_off", "inactive_engine_off")
        .when(c("thermal") == "unknown", "unknown")
        .when(yes((v < m["moving_kmh"]) & (F.abs(a) < band)), "idle")
        .when(moving & yes((c("vsp_kw_per_t") >= m["high_load_vsp"]) | (a >= m["high_load_accel"])), "high_load")
        .when(moving & yes(a >= band), "acceleration")
        .when(moving & yes(a <= -band), "deceleration")
        .otherwise("steady_driving")
    )
    return df.withColumn("child_now", raw).withColumn("child_raw", F.coalesce(forward_fill("child_now"), F.lit("unknown"))).drop("child_now")


def smooth_states(states: list[str], shortest: int = 3, protected: frozenset[str] = frozenset(("inactive_engine_off", "unknown")), passes: int = 5) -> list[str]:
    """Short runs take over a neighbour's state, left to right, seeing what the pass has rewritten; protected states neither change nor spread."""
    values = list(states)
    for _ in range(passes):
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        before = values.copy()
        for start, end in zip(cuts, cuts[1:]):
            if end - start >= shortest or end == start or values[start] in protected:
                continue
            left = values[start - 1] if start and values[start - 1] not in protected else None
            right = values[end] if end < len(values) and values[end] not in protected else None
            if left or right:
                values[start:end] = [left or right] * (end - start)
        if values == before:
            break
    return values


def smoothed(df: DataFrame, shortest: int = 3) -> DataFrame:
    """Keys, thermal and ``child``: states smoothed in order within each segment.

    The rule is sequential, so Python sees one segment at a time: its key and state columns only.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_in_segment")
        frame["child"] = smooth_states(frame["child_raw"].tolist(), shortest)
        return frame.drop(columns="child_raw")

    narrow = df.select(*KEYS, "thermal", "child_raw")
    schema = f"trip_id string, segment_id string, row_in_segment {dict(df.dtypes)['row_in_segment']}, thermal string, child string"
    out = narrow.groupBy("trip_id", "segment_id").applyInPandas(one, schema)
    return out.withColumn("child", F.when((F.col("thermal") != "engine_off") & (F.col("child") == "inactive_engine_off"), "unknown").otherwise(F.col("child")))


def operating_state(thermal: str = "thermal", child: str = "child"):
    t, c = F.col(thermal), F.col(child)
    return F.when(t == "engine_off", "engine_off").when((t != "unknown") & (c != "unknown"), F.concat_ws("__", t, c)).otherwise("unknown")


def state_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(group_type, value, rows, share) of each state column: one pass over the unpivoted cells."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("group_type"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    n = long.groupBy("group_type", "value").agg(F.count("*").alias("rows"))
    return n.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy("group_type")))


def signal_summary(df: DataFrame, state: str, signals: tuple[str, ...]) -> DataFrame:
    """Per state and signal: n, nulls, mean, deviation, extremes and exact quantiles."""
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("v")) for s in signals]))
    long = df.select(F.col(state).alias("state"), cells.alias("s")).select("state", "s.*")
    out = long.groupBy("state", "signal").agg(
        F.count("v").alias("n"), (F.count("*") - F.count("v")).alias("nulls"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    q = exact_quantiles(long, ("state", "signal"), "v", (0.01, 0.05, 0.5, 0.95, 0.99)).select(F.col("state").alias("s_"), F.col("signal").alias("g_"), "q")
    out = out.join(q, F.col("state").eqNullSafe(F.col("s_")) & (F.col("signal") == F.col("g_")), "left")
    return out.select("state", "signal", "n", "nulls", "mean", "std", "min", "max", *[F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p5", "p50", "p95", "p99"))])


def quality_issues():
    """Array of what is missing for the state of a sample: low confidence if speed or rpm is, medium if others are."""
    flags = [F.when(F.col(c).isNull(), f"missing_{c}") for c in ("speed", "rpm", "coolant_temp", "maf", "intake_temp", "ambient_temp")]
    return F.array_compact(F.array(*flags))


def confidence():
    core = F.col("speed").isNull() | F.col("rpm").isNull()
    others = F.col("coolant_temp").isNull() | F.col("maf").isNull() | F.col("intake_temp").isNull() | F.col("ambient_temp").isNull()
    return F.when(core, "low").when(others, "medium").otherwise("high")
