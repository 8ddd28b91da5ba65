"""What is made of window-risk records and decisions: chosen examples, histories, patterns, audits, and splits with a quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.functions.physics import draw
from roadlens.operators.ranks import running_totals

# Pairs of signals that are out of range together, and the pattern that they tell.
CORRELATIONS = (
    (("coolant_temp", "ect_rate_180s"), "thermal_stress_pattern"), (("coolant_temp", "ect_start"), "thermal_stress_pattern"), (("maf", "map"), "air_intake_issue"),
    (("maf", "speed_density_maf_residual"), "air_intake_issue"), (("accel_pedal_d", "accel_pedal_e"), "dual_channel_pedal_divergence"), (("accel_pedal_d", "accel_pedal_channel_delta"), "dual_channel_pedal_divergence"),
    (("pedal_mapping_residual", "accel_pedal_channel_delta"), "dual_channel_pedal_divergence"), (("intake_temp", "intake_ambient_delta"), "intake_temperature_sensor_pattern"),
    (("intake_temp", "intake_temp_stability"), "intake_temperature_sensor_pattern"), (("map", "rpm"), "map_load_plausibility_issue"), (("map", "map_range_60s"), "map_load_plausibility_issue"),
    (("map", "speed_density_maf_residual"), "map_load_plausibility_issue"),
)


def known_correlations(abnormal: Column) -> Column:
    """The patterns all of whose signals are in ``abnormal``, an array, each once, in the order above."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, own)), abnormal)) == 0, name) for own, name in CORRELATIONS])))


def representatives(records: DataFrame) -> DataFrame:
    """One record per type and level: of the greatest confidence, then score, then of the trip with the most windows, then the first."""
    windows = F.count("*").over(Window.partitionBy("trip_id"))
    best = F.struct(F.col("prediction_confidence"), F.col("risk_score"), F.col("history"), -F.col("start_t"))
    r = records.withColumn("history", windows)
    keep = F.struct("trip_id", "segment_id", "window_no", "risk_score", "prediction_confidence", "history")
    return r.groupBy("anomaly_type", "risk_level").agg(F.max_by(keep, F.struct(best, "trip_id", "segment_id", "window_no")).alias("r")).select("anomaly_type", "risk_level", "r.*")


def component_history(records: DataFrame) -> DataFrame:
    """(anomaly_type, place, end_t, trip_id, segment_id, window_no, risk_score, secondary): all risks of each component in time, first and second ones alike, numbered from 1.

    A row a risk: no component's history is gathered in one place, and places are counted by ranges of time.
    """
    risk = lambda x, second: F.struct(x("anomaly_type").alias("anomaly_type"), x("risk_score").alias("risk_score"), F.lit(second).alias("secondary"))
    two = F.col("secondary_risk")
    both = records.select("end_t", "trip_id", "segment_id", "window_no", F.explode(F.array(risk(F.col, False), risk(lambda c: two[c], True))).alias("r"))
    both = both.select("r.*", "end_t", "trip_id", "segment_id", "window_no").where("anomaly_type is not null and risk_score is not null")
    order = ("end_t", "trip_id", "segment_id", "window_no", "secondary", "anomaly_type")
    return running_totals(both, order, {"place": F.lit(1).cast("long")}, by=("anomaly_type",))


def audit_decisions(decisions: DataFrame) -> DataFrame:
    """Per check: rows, triggered and emitted ones, trips, and its distinct codes."""
    return decisions.groupBy("sub_check_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("result_state") == "triggered").alias("triggered"), F.count_if("dtc_emitted").alias("emitted"), F.count_distinct("trip_id").alias("trips"),
        F.array_join(F.array_sort(F.collect_set("routed_dtc")), ",").alias("codes"),
    )


def split_manifest(samples: DataFrame, unhealthy: Column, least: int, seed: str = "split", one_in: int = 5) -> DataFrame:
    """(trip_id, segment_id, rows, unhealthy, part, reason): a row a segment. One with an unhealthy row, or too few rows, is excluded with the reason; the others go to ``train`` or ``validation`` by trip."""
    s = samples.groupBy("trip_id", "segment_id").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(unhealthy, F.lit(True))).alias("unhealthy"))
    reason = F.when(F.col("unhealthy") > 0, "unhealthy_rows").when(F.col("rows") < least, "too_few_rows")
    part = F.when(reason.isNotNull(), "excluded").when(draw(F.lit(seed), F.col("trip_id")) % one_in == 0, "validation").otherwise("train")
    return s.withColumns({"part": part, "reason": reason})


def label_crosscheck(samples: DataFrame, label: Column, states: tuple[str, ...]) -> DataFrame:
    """Per label of the trips, told from their files: trips, and the mean over trips of the share of each state."""
    t = samples.groupBy("trip_id", label.alias("label")).agg(F.count("*").alias("n"), *[F.count_if(F.col("child_state") == s).alias(s) for s in states])
    return t.groupBy("label").agg(F.count("*").alias("trips"), *[F.avg(F.col(s) / F.col("n")).alias(f"{s}_share") for s in states])


def first_steps(samples: DataFrame, needed: int = 4, split: dict | None = None, steps: dict | None = None) -> DataFrame:
    """The first ``needed`` pedal steps, row by row, of every segment that has as many, with the span of the rows that 5-S1 reads about them.

    A step is warmed up, confident, as steep as its state asks, and has a pressure; in steady driving it must reach the split
    of magnitude too, below which no limit tells a response. ``split`` and ``steps`` are by the state after the thermal one.
    """
    steps, split = dict(steps or k.PEDAL_STEPS), split or {}
    steps["steady_driving"] = max(steps["steady_driving"], split.get("steady_driving", 0.0))
    least = F.element_at(F.create_map(*[F.lit(x) for s, v in steps.items() for x in (f"post_warmup__{s}", v)]), F.col("operating_state"))
    w = Window.partitionBy("trip_id", "segment_id").orderBy("row_in_segment")
    around = samples.withColumns({"from": F.coalesce(F.lag("t").over(w), F.col("t")), "to": F.coalesce(F.lead("t", 2).over(w), F.lead("t").over(w), F.col("t"))})
    hit = (F.col("thermal_state") == "post_warmup") & (F.col("condition_confidence") == "high") & (F.col("pedal_slope") >= least) & F.col("map").isNotNull()
    found = around.where(hit).withColumn("k", F.row_number().over(w)).where(F.col("k") <= needed)
    whole = Window.partitionBy("trip_id", "segment_id")  # ``needed`` rows at most
    found = found.withColumns({"n": F.count("*").over(whole), "start_t": F.min("from").over(whole), "end_t": F.max("to").over(whole)})
    return found.where(F.col("n") == needed).select("trip_id", "segment_id", "row_in_segment", "k", "start_t", "end_t")


def warmup_episodes(samples: DataFrame, context: DataFrame, followup_s: int = 900, start_max: float = 50.0, frost: float = -7.0) -> DataFrame:
    """Of each trip the first observed start in which a warm-up fault can be put in: cold, not frosty, and observed for ``followup_s`` seconds with a sample for each."""
    c = context.where("episode_id is not null").join(samples.select("trip_id", "segment_id", "row_in_segment", "t"), ["trip_id", "segment_id", "row_in_segment"])
    early = F.col("elapsed_since_start") <= followup_s
    e = c.groupBy("trip_id", "episode_id", "segment_id").agg(
        F.min(F.when(early, F.col("t"))).alias("start_t"), F.max(F.when(early, F.col("t"))).alias("end_t"), F.count_if(early).alias("samples"), F.max("elapsed_since_start").alias("longest"), F.first("ect_start").alias("ect"), F.first("aat_start").alias("aat")
    )
    e = e.where((F.col("ect") <= start_max) & (F.col("aat") >= frost) & (F.col("longest") >= followup_s) & (F.col("samples") >= followup_s))
    kept = F.struct("episode_id", "segment_id", "start_t", "end_t", "samples")
    return e.groupBy("trip_id").agg(F.min_by(kept, F.struct("start_t", "segment_id")).alias("e")).select("trip_id", "e.*")


def relative_change(before: Column, after: Column) -> Column:
    """(after - before) over the size of before; null where before is 0."""
    return F.try_divide(after - before, F.abs(before))
