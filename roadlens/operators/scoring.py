"""Risk of a window against its forecast, forwarding of decisions, and the trend over trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.functions.physics import norm_cdf, risk_level, scale01, steady_mean, tidy
from roadlens.operators.ranks import running_totals

FORECAST = ("rpm", "speed", "coolant_temp", "map", "maf", "tps")
TYPES = tuple(k.PRIORITY_SIGNALS)
WINDOW = ("trip_id", "segment_id", "window_no")
#: Types whose scores are those of decisions that were taken before.
FORWARDED = ("intake_air_temperature_sensor_fault", "map_load_signal_plausibility_fault")
# Scores of forwarded decisions, and the number that stands for each confidence.
EMITTED, VERDICT, EVIDENCE, NONE = 0.9, 0.6, 0.5, 0.0
CONFIDENCE, UNKNOWN = {"high": 0.9, "provisional": 0.6, "low": 0.35}, 0.35
EVIDENCE_ROLES = ("support", "arbitration_evidence", "pending_precursor")
#: What a record's signal is worth: (column, how it is taken over the window).
VALUES = {s: (s, "last") for s in ("coolant_temp", "map", "maf", "tps", "rpm", "speed", "accel_pedal_d", "accel_pedal_e", "intake_temp", "ambient_temp", "intake_ambient_delta")} | {
    "ect_rate_180s": ("ect_rate", "mean"), "maf_integral_180s": ("maf_integral", "mean"), "speed_density_maf_residual": ("speed_density_maf_residual", "median"),
    "accel_pedal_channel_delta": ("accel_pedal_channel_delta", "mean"), "pedal_slope": ("pedal_slope", "mean"), "rpm_slope": ("rpm_slope", "mean"),
    "map_range_60s": ("map_range", "max"), "intake_temp_stability": ("intake_temp_stability", "mean"),
}


def persistence_forecast(windows: DataFrame, context: int, horizon: int) -> DataFrame:
    """(window, step and ``<signal>_forecast``): the last sample of the context, repeated over the horizon. The baseline that any forecast table has to beat."""
    last = windows.where(F.col("step") == context - 1)
    step = F.explode(F.sequence(F.lit(context), F.lit(context + horizon - 1))).alias("step")
    return last.select(*WINDOW, step, *[F.col(s).alias(f"{s}_forecast") for s in FORECAST])


def join_forecast(truth: DataFrame, forecast: DataFrame) -> DataFrame:
    """``truth`` with the forecast of its window and step; rows without one are left out."""
    return truth.join(forecast, [*WINDOW, "step"])


def window_residuals(df: DataFrame, keys: tuple[str, ...] = WINDOW) -> DataFrame:
    """Per window: mean and greatest absolute residual of each forecast signal, ``score_<signal>``, and the window's values.

    A score is the mean residual over the width of the signal's healthy range, at least 1, and 1 at most.
    """
    aggs = []
    for s in FORECAST:
        lo, hi = k.REFERENCE_RANGES[s]
        off = F.abs(F.col(f"{s}_forecast") - F.col(s))
        aggs += [F.avg(off).alias(f"mean_{s}"), F.max(off).alias(f"max_{s}"), F.least(F.avg(off) / max(hi - lo, 1.0), F.lit(1.0)).alias(f"score_{s}")]
    how = {"last": lambda c: F.max_by(c, "step"), "mean": F.avg, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5))}
    values = [how[h](c).alias(f"v_{n}") for n, (c, h) in VALUES.items()]
    return df.groupBy(*keys).agg(*aggs, *values, F.max("coolant_temp").alias("max_ect"), F.min("t").alias("start_t"), F.max("t").alias("end_t"))


def component_scores(w: DataFrame) -> DataFrame:
    """``w`` with the two highest ``risks`` (type, score, confidence), the ``top_signals`` and ``notes``.

    Scores of the forwarded types and their confidence are columns ``<type>_score`` and ``<type>_confidence``,
    nothing where they are missing. Ties go to the type, or signal, that stands first. Confidence is 1 less
    the population deviation of the residual scores, within 0.35 and 0.95; that of a forwarded score above
    0 is its own. A missing pedal scores 0 and adds a note.
    """
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    given = lambda n, x: F.coalesce(c(n), F.lit(x)) if n in w.columns else F.lit(x)
    ect = zero(c("max_ect"))
    cooling = F.greatest(zero(c("score_coolant_temp")), scale01(ect, 95, 110), F.when(ect > 85, scale01(zero(c("v_ect_rate_180s")), 2, 8)).otherwise(0.0))
    intake = F.greatest(zero(c("score_maf")), zero(c("score_map")), scale01(F.abs(zero(c("v_speed_density_maf_residual"))), 18, 35))
    pedal = zero(scale01(c("v_accel_pedal_channel_delta"), 2, 10))
    values = [cooling, intake, pedal, *[given(f"{f}_score", 0.0) for f in FORWARDED]]
    residual = F.array(*[zero(c(f"score_{s}")) for s in FORECAST])
    mean = F.aggregate(residual, F.lit(0.0), lambda a, x: a + x) / len(FORECAST)
    signals = F.array(*[F.struct((-zero(c(f"score_{s}"))).alias("order"), F.lit(i).alias("rank"), F.lit(s).alias("signal")) for i, s in enumerate(FORECAST)])
    w = w.withColumn("_mean", mean)
    std = F.sqrt(F.aggregate(residual, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / len(FORECAST))
    w = w.withColumn("_own", F.greatest(F.lit(0.35), F.least(F.lit(0.95), 1 - std)))
    sure = [F.when(v > 0, given(f"{t}_confidence", UNKNOWN)).otherwise(c("_own")) if t in FORWARDED else c("_own") for t, v in zip(TYPES, values)]
    scores = F.array(*[F.struct((-v).alias("order"), F.lit(i).alias("rank"), F.lit(t).alias("anomaly_type"), v.alias("score"), q.alias("confidence")) for i, (t, v, q) in enumerate(zip(TYPES, values, sure))])
    w = w.withColumns(
        {
            "risks": F.transform(F.slice(F.array_sort(scores), 1, 2), lambda x: F.struct(x["anomaly_type"].alias("anomaly_type"), x["score"].alias("score"), x["confidence"].alias("confidence"))),
            "top_signals": F.transform(F.slice(F.array_sort(signals), 1, 3), lambda x: x["signal"]),
        }
    ).drop("_mean", "_own")
    told = [F.when(c("v_accel_pedal_channel_delta").isNull(), F.lit("no pair of pedal readings in the window: its score is 0"))]
    named = lambda t: F.exists("risks", lambda x: (x["anomaly_type"] == t) & (x["score"] > 0))
    told += [F.when(named(t), F.concat(F.lit(f"{t}: decided by "), c(f"{t}_checks"))) for t in FORWARDED if f"{t}_checks" in w.columns]
    return w.withColumn("notes", F.array_compact(F.array(*told)))


def key_signals(anomaly_type: Column, top: Column, most: int = 5) -> Column:
    """Array of (feature, value, unit, reference_range): the type's own signals, then those with the largest residuals; each once, those without a value left out."""
    first = F.element_at(F.create_map(*[x for t, own in k.PRIORITY_SIGNALS.items() for x in (F.lit(t), F.array(*map(F.lit, own)))]), anomaly_type)
    table = F.create_map(*[x for n in VALUES for x in (F.lit(n), F.struct(F.col(f"v_{n}").alias("value"), F.lit(k.UNITS[n]).alias("unit"), F.array(*map(F.lit, k.REFERENCE_RANGES[n])).alias("reference_range")))])
    held = F.filter(F.array_distinct(F.concat(first, top)), lambda n: F.coalesce(F.try_element_at(table, n)["value"].isNotNull(), F.lit(False)))
    told = lambda n: F.try_element_at(table, n)
    return F.transform(F.slice(held, 1, most), lambda n: F.struct(n.alias("feature"), tidy(told(n)["value"], 4).alias("value"), told(n)["unit"].alias("unit"), told(n)["reference_range"].alias("reference_range")))


def risk_records(scored: DataFrame) -> DataFrame:
    """Record of a window: its highest risk with level, confidence and key signals, and ``secondary_risk``, the same of the next one."""

    def one(r: Column) -> list[Column]:
        score = tidy(r["score"], 4)
        return [
            r["anomaly_type"].alias("anomaly_type"), score.alias("risk_score"), risk_level(r["score"]).alias("risk_level"), tidy(r["confidence"], 4).alias("prediction_confidence"),
            key_signals(r["anomaly_type"], F.col("top_signals")).alias("key_signals"),
        ]

    return scored.select(*WINDOW, "start_t", "end_t", *one(F.col("risks")[0]), F.struct(*one(F.col("risks")[1])).alias("secondary_risk"), "top_signals", "notes")


def _strength() -> tuple[Column, Column]:
    """Score and confidence of a triggered decision; null scores count for nothing."""
    role = F.col("decision_role")
    level = F.when(role == "verdict", F.when(F.col("dtc_emitted"), EMITTED).otherwise(VERDICT)).when(role.isin(*EVIDENCE_ROLES), EVIDENCE)
    known = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("confidence"))
    return level, F.when(F.coalesce("confidence_capped_low", F.lit(False)), CONFIDENCE["low"]).otherwise(F.coalesce(known, F.lit(UNKNOWN)))


def forward(decisions: DataFrame, windows: DataFrame, proxy: str) -> DataFrame:
    """Per window: score, confidence and checks of a proxy's triggered decisions that cover it.

    Those cover it that are of its trip, and of its segment where they are of a segment's first row and name
    it. Emitted verdicts score 0.9, other verdicts 0.6, evidence 0.5; the strongest count, with the weakest
    confidence among them, and a cap makes it low. A decision of 5-S2 that is routed to another sensor does
    not count. Decisions are reduced to one row a trip and one a segment before they are joined, so the work
    is that of the windows and of the decisions, not of their pairs.
    """
    level, how = _strength()
    routed = F.col("routed_dtc") if "routed_dtc" in decisions.columns else F.lit(None).cast("string")
    elsewhere = (F.col("sub_check_id") == "5-S2") & routed.isNotNull() & (routed != "P0106")
    d = decisions.where((F.col("proxy_id") == proxy) & (F.col("result_state") == "triggered") & ~F.coalesce(elsewhere, F.lit(False)))
    d = d.select(F.col("trip_id").alias("d_trip"), F.when(F.col("unit_scope") == "segment_first_row", F.col("segment_id")).alias("d_segment"), level.alias("level"), how.alias("how"), "sub_check_id").where("level is not null")
    d = d.groupBy("d_trip", "d_segment", "level").agg(F.min("how").alias("how"), F.collect_set("sub_check_id").alias("checks"))
    best = d.groupBy("d_trip", "d_segment").agg(F.max_by(F.struct("level", "how", "checks"), "level").alias("b"))
    trip, own = best.where("d_segment is null").select("d_trip", F.col("b").alias("of_trip")), best.where("d_segment is not null").select(F.col("d_trip").alias("s_trip"), "d_segment", F.col("b").alias("of_segment"))
    w = windows.select(*WINDOW).join(trip, F.col("trip_id") == F.col("d_trip"), "left").join(own, (F.col("trip_id") == F.col("s_trip")) & (F.col("segment_id") == F.col("d_segment")), "left")
    both = F.array_compact(F.array("of_trip", "of_segment"))
    w = w.withColumn("score", F.coalesce(F.array_max(F.transform(both, lambda x: x["level"])), F.lit(NONE))).withColumn("counted", both)
    counted = F.filter("counted", lambda x: x["level"] == F.col("score"))
    return w.select(
        *WINDOW, "score", F.coalesce(F.array_min(F.transform(counted, lambda x: x["how"])), F.lit(UNKNOWN)).alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(counted, lambda x: x["checks"])))), ", ").alias("checks"),
    )


def with_forwarded(w: DataFrame, decisions: DataFrame) -> DataFrame:
    """``w`` with score, confidence and checks of each forwarded type."""
    for t in FORWARDED:
        f = forward(decisions, w, t).select(*WINDOW, *[F.col(c).alias(f"{t}_{c}") for c in ("score", "confidence", "checks")])
        w = w.join(f, list(WINDOW))
    return w


def trip_risk(history: DataFrame, group: str) -> DataFrame:
    """Per group and trip: first time, mean risk, windows, and the trip's cycle index in time order, from 0."""
    t = history.groupBy(group, "trip_id").agg(F.min("t").alias("t"), steady_mean(F.col("risk_score")).alias("risk"), F.count("*").alias("windows"))
    t = running_totals(t, ("t", "trip_id", group), {"cycle": F.lit(1).cast("long")}, by=(group,))  # by ranges of time: there are few groups, and any number of trips
    return t.withColumn("cycle", F.col("cycle") - 1)


def project(trips: DataFrame, group: str, threshold: float = k.RISK_HIGH, least: int = k.TREND_TRIPS, horizon: int = k.TREND_HORIZON, most: int = k.TREND_CAP) -> DataFrame:
    """Per group: slope and intercept over trips, the probability of reaching ``threshold`` within ``horizon`` trips, and the trips until it.

    Nulls with fewer than ``least`` trips; no cycles without a rising trend or beyond ``most``; 0 and certainty
    where the last trip is there already. Moments come from one aggregate.
    """
    x, y = F.col("cycle").cast("double"), F.col("risk")
    a = trips.groupBy(group).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.avg(x).alias("mx"), F.max_by("risk", "cycle").alias("last"), F.max("cycle").alias("lx"),
    )
    c = F.col
    sse = F.greatest(c("syy") - F.try_divide(c("sxy") * c("sxy"), c("sxx")), F.lit(0.0))
    fx = c("lx") + horizon
    mean = c("intercept") + c("slope") * fx
    se = F.sqrt(F.try_divide(sse, c("n") - 2)) * F.sqrt(1 + 1 / c("n") + F.try_divide((fx - c("mx")) * (fx - c("mx")), c("sxx")))
    p = F.when(se < 1e-12, (mean >= threshold).cast("double")).otherwise(1 - norm_cdf(F.try_divide(threshold - mean, se)))
    cycles = F.ceil(F.try_divide(threshold - c("last"), c("slope")) - 1e-12)
    enough, there = c("n") >= least, c("last") >= threshold
    return a.select(
        group, c("n").alias("trips"), F.when(enough, F.round("slope", 8)).alias("slope"), F.when(enough, F.round("intercept", 8)).alias("intercept"),
        F.when(enough, F.when(there, 1.0).otherwise(F.round(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), 4))).alias("probability"),
        F.when(enough, F.when(there, 0).when((c("slope") > 0) & (cycles <= most), cycles)).cast("int").alias("cycles"),
    )


def is_affected(level: Column, score: Column) -> Column:
    return F.when(level.isin("Medium", "High"), True).when(level == "Low", False).otherwise(F.coalesce(score >= 0.5, F.lit(False)))


def append_history(new: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of ``new`` whose (trip, window) the history does not hold yet, one of each."""
    return new.dropDuplicates(["trip_id", "window_id"]).join(history.select("trip_id", "window_id"), ["trip_id", "window_id"], "left_anti")
