"""Queries of risk records and decisions as they are used (S-12, X-20, X-23, X-24, T-07, T-09, U-05, A-28, D-31, I-03, I-04, T-11, M-13, P-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import records as r
from roadlens.operators.starts import start_episodes, with_start_context
from roadlens.plans.registry import query
from roadlens.plans.rules import DECIDED, PROD, SPLITS, all_decisions, prod, samples
from roadlens.plans.scoring import SCORED, risks
from roadlens.plans.sql import tidy_sql, with_ticks
from roadlens.plans.starts import CTX, EP
from roadlens.sources.adapters import table, ticks
from roadlens.sources.scratch import scratch, written
from roadlens.sources.sinks import read_model_output, signal_status

_RECORD = "trip_id string, segment_id string, window_no int, anomaly_type string, risk_score double, risk_level string, prediction_confidence double"


@query(with_ticks(*SCORED) + "SELECT trip_id, segment_id, window_no, anomaly_type, risk_score, risk_level, confidence AS prediction_confidence FROM rk")
def s12_x23_x24_record_json(spark, sf_dir):
    """Records written as JSON, of every other trip one by one and of the rest in an envelope a trip, a document a line, and read back alike."""
    df = written(risks(spark, sf_dir).select(*[x.split(" ")[0] for x in _RECORD.split(", ")]), "risks")  # read by both forms
    alone = F.substring("trip_id", -1, 1).isin("0", "2", "4", "6", "8")
    single = df.where(alone).select(F.to_json(F.struct(*df.columns)).alias("value"))
    batch = df.where(~alone).groupBy("trip_id").agg(F.collect_list(F.struct(*df.columns)).alias("windows")).select(F.to_json(F.struct("windows")).alias("value"))
    folder = scratch(spark, "records")
    single.unionByName(batch).write.text(folder)
    return read_model_output(spark, folder, _RECORD, lines=True)


@query(
    with_ticks(*SCORED, "h AS (SELECT *, count(*) OVER (PARTITION BY trip_id) AS history FROM rk)", "o AS (SELECT *, row_number() OVER (PARTITION BY anomaly_type, risk_level ORDER BY confidence DESC, risk_score DESC, history DESC, start_t, trip_id DESC, segment_id DESC, window_no DESC) AS k FROM h)")
    + "SELECT anomaly_type, risk_level, trip_id, segment_id, window_no, risk_score, confidence AS prediction_confidence, history FROM o WHERE k = 1"
)
def t07_representatives(spark, sf_dir):
    return r.representatives(risks(spark, sf_dir))


@query(
    with_ticks(*SCORED, "hy AS (SELECT anomaly_type, risk_score, FALSE AS secondary, end_t, trip_id, segment_id, window_no FROM rk UNION ALL SELECT secondary_type, secondary_score, TRUE, end_t, trip_id, segment_id, window_no FROM rk)")
    + "SELECT *, row_number() OVER (PARTITION BY anomaly_type ORDER BY end_t, trip_id, segment_id, window_no, secondary) AS place FROM hy"
)
def t09_component_history(spark, sf_dir):
    return r.component_history(risks(spark, sf_dir))


_BAD = "(CASE {x} WHEN 'rpm' THEN {v} NOT BETWEEN 0 AND 3682 WHEN 'speed' THEN {v} NOT BETWEEN 0 AND 218 WHEN 'coolant_temp' THEN {v} NOT BETWEEN 90 AND 95 WHEN 'map' THEN {v} NOT BETWEEN 36 AND 237 WHEN 'maf' THEN {v} NOT BETWEEN 0 AND 123 WHEN 'tps' THEN {v} NOT BETWEEN 0 AND 89 WHEN 'accel_pedal_d' THEN {v} NOT BETWEEN 0 AND 100 WHEN 'accel_pedal_e' THEN {v} NOT BETWEEN 0 AND 100 WHEN 'accel_pedal_channel_delta' THEN {v} NOT BETWEEN 0 AND 10 WHEN 'ect_rate_180s' THEN {v} NOT BETWEEN 0 AND 2 WHEN 'intake_temp' THEN {v} NOT BETWEEN -3 AND 41 WHEN 'ambient_temp' THEN {v} NOT BETWEEN -7 AND 25 WHEN 'intake_ambient_delta' THEN {v} NOT BETWEEN 0 AND 20 WHEN 'speed_density_maf_residual' THEN {v} NOT BETWEEN -20 AND 20 WHEN 'rpm_slope' THEN {v} NOT BETWEEN -120 AND 135 WHEN 'maf_integral_180s' THEN {v} NOT BETWEEN 0 AND 2500 WHEN 'intake_temp_stability' THEN {v} NOT BETWEEN 0 AND 5 WHEN 'map_range_60s' THEN {v} NOT BETWEEN 0 AND 80 ELSE {v} NOT BETWEEN -2.4 AND 2.4 END)"


@query(
    with_ticks(*SCORED, "ab AS (SELECT trip_id, segment_id, window_no, list_filter(keyed, lambda x: " + _BAD.format(x="x", v="CAST(round(CAST(map_extract(vs, x)[1] AS DECIMAL(32, 9)), 4) AS DOUBLE)") + ") AS a FROM rk)")
    + """SELECT trip_id, segment_id, window_no, concat_ws(',', CASE WHEN list_contains(a, 'coolant_temp') AND (list_contains(a, 'ect_rate_180s') OR list_contains(a, 'ect_start')) THEN 'thermal_stress_pattern' END,
 CASE WHEN list_contains(a, 'maf') AND (list_contains(a, 'map') OR list_contains(a, 'speed_density_maf_residual')) THEN 'air_intake_issue' END,
 CASE WHEN (list_contains(a, 'accel_pedal_d') AND (list_contains(a, 'accel_pedal_e') OR list_contains(a, 'accel_pedal_channel_delta'))) OR (list_contains(a, 'pedal_mapping_residual') AND list_contains(a, 'accel_pedal_channel_delta')) THEN 'dual_channel_pedal_divergence' END,
 CASE WHEN list_contains(a, 'intake_temp') AND (list_contains(a, 'intake_ambient_delta') OR list_contains(a, 'intake_temp_stability')) THEN 'intake_temperature_sensor_pattern' END,
 CASE WHEN list_contains(a, 'map') AND (list_contains(a, 'rpm') OR list_contains(a, 'map_range_60s') OR list_contains(a, 'speed_density_maf_residual')) THEN 'map_load_plausibility_issue' END) AS patterns FROM ab"""
)
def u05_known_correlations(spark, sf_dir):
    odd = F.transform(F.filter("key_signals", lambda s: signal_status(s["value"], s["reference_range"]) == "ABNORMAL"), lambda s: s["feature"])
    return risks(spark, sf_dir).select("trip_id", "segment_id", "window_no", F.array_join(r.known_correlations(odd), ",").alias("patterns"))


@query(
    with_ticks(*DECIDED)
    + "SELECT sub_check_id, count(*) AS rows, count(*) FILTER (result_state = 'triggered') AS triggered, count(*) FILTER (dtc_emitted) AS emitted, count(DISTINCT trip_id) AS trips, coalesce(string_agg(DISTINCT routed_dtc, ',' ORDER BY routed_dtc), '') AS codes FROM rt GROUP BY sub_check_id"
)
def a28_decision_audit(spark, sf_dir):
    return r.audit_decisions(all_decisions(samples(spark, sf_dir)))


@query(
    with_ticks("s AS (SELECT trip_id, segment_id, count(*) AS rows, count(*) FILTER (coalesce(condition_confidence <> 'high' OR (maf_is_suspicious AND speed > 60), TRUE)) AS unhealthy FROM ticks GROUP BY ALL)")
    + """SELECT trip_id, segment_id, rows, unhealthy, CASE WHEN unhealthy > 0 THEN 'unhealthy_rows' WHEN rows < 150 THEN 'too_few_rows' END AS reason,
 CASE WHEN unhealthy > 0 OR rows < 150 THEN 'excluded' WHEN CAST(('0x' || substr(md5('split:' || trip_id), 1, 8)) AS BIGINT) % 5 = 0 THEN 'validation' ELSE 'train' END AS part FROM s"""
)
def m13_p16_split_manifest(spark, sf_dir):
    return r.split_manifest(ticks(spark, sf_dir), (F.col("condition_confidence") != "high") | (F.col("maf_is_suspicious") & (F.col("speed") > 60)), 150)


@query(
    with_ticks("t AS (SELECT trip_id, CASE CAST(substr(trip_id, 6) AS INTEGER) % 3 WHEN 0 THEN 'Frei' WHEN 1 THEN 'Normal' ELSE 'Stau' END AS label, count(*) AS n, count(*) FILTER (child_state = 'idle') AS i, count(*) FILTER (child_state = 'steady_driving') AS s, count(*) FILTER (child_state = 'high_load') AS h FROM ticks GROUP BY ALL)")
    + f"SELECT label, count(*) AS trips, {tidy_sql('avg(i / n)', 6)} AS idle_share, {tidy_sql('avg(s / n)', 6)} AS steady_driving_share, {tidy_sql('avg(h / n)', 6)} AS high_load_share FROM t GROUP BY label"
)
def d31_x03_label_crosscheck(spark, sf_dir):
    """Shares of states by the condition in the trips' file names."""
    k = F.regexp_extract("trip_id", r"trip_([0-9]+)", 1).cast("int") % 3
    df = r.label_crosscheck(ticks(spark, sf_dir), F.when(k == 0, "Frei").when(k == 1, "Normal").otherwise("Stau"), ("idle", "steady_driving", "high_load"))
    return df.withColumns({c: F.round(F.round(c, 9), 6) for c in df.columns if c.endswith("_share")})


_STEPS = """fs AS (SELECT *, row_number() OVER (PARTITION BY trip_id, segment_id ORDER BY row_in_segment) AS k, count(*) OVER (PARTITION BY trip_id, segment_id) AS n FROM prod WHERE condition_confidence = 'high' AND map IS NOT NULL AND pedal_slope >=
 CASE operating_state WHEN 'post_warmup__idle' THEN 9.2 WHEN 'post_warmup__steady_driving' THEN 20.0 WHEN 'post_warmup__acceleration' THEN 18.6 WHEN 'post_warmup__high_load' THEN 26.5 END)"""


@query(with_ticks(PROD, _STEPS, "f4 AS (SELECT trip_id, segment_id, row_in_segment, t, k FROM fs WHERE n >= 4 AND k <= 4)", "tw AS (SELECT f4.trip_id, f4.segment_id, min(p.t) AS start_t, max(p.t) AS end_t FROM f4 JOIN prod p ON p.trip_id = f4.trip_id AND p.segment_id = f4.segment_id AND p.row_in_segment BETWEEN f4.row_in_segment - 1 AND f4.row_in_segment + 2 GROUP BY ALL)")
       + "SELECT f4.trip_id, f4.segment_id, row_in_segment, CAST(k AS INTEGER) AS k, start_t, end_t FROM f4 JOIN tw USING (trip_id, segment_id)")
def i04_t11_first_steps(spark, sf_dir):
    """Four steps of the 5-S1 domain in each segment that has as many; small steps of steady driving, which no limit tells apart, are left out."""
    return r.first_steps(prod(spark, sf_dir), split=SPLITS)


_WARM = "g AS (SELECT trip_id, episode_id, segment_id, min(k.t) FILTER (elapsed_since_start <= 12) AS start_t, max(k.t) FILTER (elapsed_since_start <= 12) AS end_t, max(elapsed_since_start) AS longest, count(*) FILTER (elapsed_since_start <= 12) AS samples, any_value(ect_start) AS e, any_value(aat_start) AS a FROM cx JOIN ticks k USING (trip_id, segment_id, row_in_segment) WHERE episode_id IS NOT NULL GROUP BY ALL)"


@query(with_ticks(EP, CTX, _WARM, "o AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY start_t) AS n FROM g WHERE e <= 50 AND a >= -7 AND longest >= 12 AND samples >= 12)") + "SELECT trip_id, episode_id, segment_id, start_t, end_t, samples FROM o WHERE n = 1")
def i03_warmup_episodes(spark, sf_dir):
    """Twelve seconds to follow, where production asks for 900."""
    df = ticks(spark, sf_dir)
    return r.warmup_episodes(df, with_start_context(df, start_episodes(df)), 12)


@query(
    f"""WITH p AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DOUBLE)) AS paid FROM lineitem GROUP BY l_orderkey), j AS (SELECT o_orderkey, (paid - o_totalprice) / abs(o_totalprice) AS c FROM orders JOIN p ON k = o_orderkey)
SELECT o_orderkey, {tidy_sql('c', 4)} AS change, {tidy_sql('abs(c)', 6)} <= 0.05 AS within FROM j"""
)
def x20_relative_change(spark, sf_dir):
    paid = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("double")).alias("paid"))
    c = r.relative_change(F.col("o_totalprice").cast("double"), F.col("paid"))
    return table(spark, sf_dir, "orders").join(paid, "o_orderkey").select("o_orderkey", F.round(F.round(c, 9), 4).alias("change"), (F.round(F.round(F.abs(c), 9), 6) <= 0.05).alias("within"))
