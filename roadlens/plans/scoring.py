"""Queries of window risks, trends, evaluation, calibration and perturbation (M-*, A-13 to A-23, T-*, C-*, I-*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.functions.physics import draw, norm_cdf, percent_text, risk_level, round_significant, steady_mean, tidy, wilson
from roadlens.operators import evaluation as e
from roadlens.operators import scoring as s
from roadlens.operators.continuity import KEYS as KEY
from roadlens.operators.continuity import longest_runs, segment_window
from roadlens.operators.ranks import exact_quantiles, numbered
from roadlens.operators.rolling import tumble_rows
from roadlens.plans.registry import query
from roadlens.plans.rules import DECIDED, PROD, all_decisions, prod, samples
from roadlens.plans.sql import KEYS, SEG, tidy_sql, with_irregular, with_ticks
from roadlens.sources.adapters import irregular, table, ticks
from roadlens.sources.scratch import written
from roadlens.sources.sinks import signal_status

#: Windows of 60 rows in segments of 70 at least: a context of 48 and a horizon of 12, where production has 512 and 96 rows in segments of 700.
CONTEXT, HORIZON, LEAST = 48, 12, 70
_WIN = f"""wn AS (SELECT *, count(*) OVER (PARTITION BY trip_id, segment_id) AS rows_here, CAST(floor((row_number() OVER ({SEG}) - 1) / 60) AS INTEGER) AS window_no, (row_number() OVER ({SEG}) - 1) % 60 AS step FROM prod),
wf AS (SELECT *, count(*) OVER (PARTITION BY trip_id, segment_id, window_no) AS k FROM wn WHERE rows_here >= 70),
fl AS (SELECT * FROM wf WHERE k = 60 AND step = 47),
fc AS (SELECT a.*, {", ".join(f"abs(b.{c} - a.{c}) AS off_{c}" for c in s.FORECAST)} FROM wf a JOIN fl b ON a.trip_id = b.trip_id AND a.segment_id = b.segment_id AND a.window_no = b.window_no WHERE a.k = 60 AND a.step >= 48),
ws AS (SELECT trip_id, segment_id, window_no, min(t) AS start_t, max(t) AS end_t, max(coolant_temp) AS max_ect,
 least(avg(off_rpm) / 3682.0, 1.0) AS s_rpm, least(avg(off_speed) / 218.0, 1.0) AS s_speed, least(avg(off_coolant_temp) / 5.0, 1.0) AS s_coolant_temp,
 least(avg(off_map) / 201.0, 1.0) AS s_map, least(avg(off_maf) / 123.0, 1.0) AS s_maf, least(avg(off_tps) / 89.0, 1.0) AS s_tps,
 {", ".join(f"avg(off_{c}) AS mean_{c}, max(off_{c}) AS max_{c}" for c in s.FORECAST)},
 {", ".join(f"max(CASE WHEN step = 59 THEN {c} END) AS v_{c}" for c in ("coolant_temp", "map", "maf", "tps", "rpm", "speed", "accel_pedal_d", "accel_pedal_e", "intake_temp", "ambient_temp", "intake_ambient_delta"))},
 avg(ect_rate) AS v_ect_rate_180s, avg(maf_integral) AS v_maf_integral_180s, quantile_cont(speed_density_maf_residual, 0.5) AS v_speed_density_maf_residual, avg(accel_pedal_channel_delta) AS v_accel_pedal_channel_delta,
 avg(pedal_slope) AS v_pedal_slope, avg(rpm_slope) AS v_rpm_slope, max(map_range) AS v_map_range_60s, avg(intake_temp_stability) AS v_intake_temp_stability FROM fc GROUP BY ALL)"""


def _windows(samples):
    df = samples.withColumn("rows_here", F.count("*").over(Window.partitionBy("trip_id", "segment_id"))).where(F.col("rows_here") >= LEAST)
    df = tumble_rows(df, CONTEXT + HORIZON)
    forecast = s.persistence_forecast(df, CONTEXT, HORIZON)
    return s.window_residuals(s.join_forecast(df.where(F.col("step") >= CONTEXT), forecast))


def _forwarded(samples):
    """The decisions of every scope, reduced to the triggered ones of the two forwarded faults."""
    return written(all_decisions(samples).where((F.col("result_state") == "triggered") & F.col("proxy_id").isin(*s.FORWARDED)), "forwarded")


_SC = "least(greatest(({x} - {lo}) / {d}, 0), 1)"
_sc = lambda x, lo, hi: _SC.format(x=x, lo=f"{lo}.0", d=f"{hi - lo}.0")
_V = ("coolant_temp", "map", "maf", "tps", "rpm", "speed", "accel_pedal_d", "accel_pedal_e", "intake_temp", "ambient_temp", "intake_ambient_delta", "ect_rate_180s", "maf_integral_180s", "speed_density_maf_residual", "accel_pedal_channel_delta", "pedal_slope", "rpm_slope", "map_range_60s", "intake_temp_stability")
_FIRST = """CASE {t} WHEN 'cooling_degradation' THEN ['coolant_temp', 'ect_rate_180s', 'maf_integral_180s'] WHEN 'air_intake_maf_anomaly' THEN ['maf', 'map', 'speed_density_maf_residual']
 WHEN 'accelerator_pedal_sensor' THEN ['accel_pedal_d', 'accel_pedal_e', 'accel_pedal_channel_delta', 'pedal_mapping_residual'] WHEN 'intake_air_temperature_sensor_fault' THEN ['intake_temp', 'intake_temp_stability', 'intake_ambient_delta', 'ambient_temp', 'coolant_temp']
 ELSE ['map', 'pedal_slope', 'speed_density_maf_residual', 'map_range_60s', 'rpm_slope'] END"""
_KEYED = "list_filter(list_concat({f}, list_filter(top, lambda x: NOT list_contains({f}, x))), lambda x: map_extract(vs, x)[1] IS NOT NULL)[1:5]"
_keyed = lambda t: _KEYED.format(f=_FIRST.format(t=t))
_FWD = """fd AS (SELECT trip_id, CASE WHEN unit_scope = 'segment_first_row' THEN segment_id END AS seg, substr(sub_check_id, 1, 1) AS p, sub_check_id AS c, CASE WHEN decision_role = 'verdict' THEN CASE WHEN dtc_emitted THEN 0.9 ELSE 0.6 END ELSE 0.5 END AS lv,
 CASE WHEN confidence_capped_low OR confidence = 'low' THEN 0.35 WHEN confidence = 'high' THEN 0.9 ELSE 0.6 END AS how FROM rt WHERE result_state = 'triggered' AND NOT (sub_check_id = '5-S2' AND coalesce(routed_dtc, 'P0106') <> 'P0106')),
fj AS (SELECT w.trip_id, w.segment_id, w.window_no, p, c, lv, how FROM ws w JOIN fd ON fd.trip_id = w.trip_id AND (seg IS NULL OR seg = w.segment_id)),
fw AS (SELECT trip_id, segment_id, window_no, p, lv AS score, min(how) AS how, string_agg(DISTINCT c, ', ' ORDER BY c) AS checks FROM (SELECT *, max(lv) OVER (PARTITION BY trip_id, segment_id, window_no, p) AS best FROM fj) WHERE lv = best GROUP BY ALL)"""
_RISK = f"""{_FWD},
r0 AS (SELECT ws.*, greatest(coalesce(s_coolant_temp, 0), {_sc("coalesce(max_ect, 0)", 95, 110)}, CASE WHEN coalesce(max_ect, 0) > 85 THEN {_sc("coalesce(v_ect_rate_180s, 0)", 2, 8)} ELSE 0 END) AS cool,
 greatest(coalesce(s_maf, 0), coalesce(s_map, 0), {_sc("abs(coalesce(v_speed_density_maf_residual, 0))", 18, 35)}) AS intake, CASE WHEN v_accel_pedal_channel_delta IS NULL THEN 0 ELSE {_sc("v_accel_pedal_channel_delta", 2, 10)} END AS pedal,
 CAST(coalesce(f4.score, 0) AS DOUBLE) AS iat, CAST(coalesce(f5.score, 0) AS DOUBLE) AS mapf, f4.checks AS c4, f5.checks AS c5, f4.how AS h4, f5.how AS h5,
 [{", ".join(f"coalesce(s_{c}, 0)" for c in s.FORECAST)}] AS rs, MAP {{{", ".join(f"'{v}': v_{v}" for v in _V)}}} AS vs
 FROM ws LEFT JOIN fw f4 ON f4.trip_id = ws.trip_id AND f4.segment_id = ws.segment_id AND f4.window_no = ws.window_no AND f4.p = '4' LEFT JOIN fw f5 ON f5.trip_id = ws.trip_id AND f5.segment_id = ws.segment_id AND f5.window_no = ws.window_no AND f5.p = '5'),
rt0 AS (SELECT trip_id, segment_id, window_no, list(sig ORDER BY x DESC, i)[1:3] AS top FROM (SELECT trip_id, segment_id, window_no, unnest(['rpm', 'speed', 'coolant_temp', 'map', 'maf', 'tps']) AS sig, unnest(rs) AS x, unnest([1, 2, 3, 4, 5, 6]) AS i FROM r0) GROUP BY ALL),
r1 AS (SELECT r0.*, top, greatest(0.35, least(0.95, 1 - sqrt(greatest(list_var_pop(rs), 0)))) AS sure, unnest([0, 1, 2, 3, 4]) AS i,
 unnest(['cooling_degradation', 'air_intake_maf_anomaly', 'accelerator_pedal_sensor', 'intake_air_temperature_sensor_fault', 'map_load_signal_plausibility_fault']) AS ty, unnest([cool, intake, pedal, iat, mapf]) AS sc FROM r0 JOIN rt0 USING (trip_id, segment_id, window_no)),
r2 AS (SELECT *, CASE WHEN i = 3 AND sc > 0 THEN h4 WHEN i = 4 AND sc > 0 THEN h5 ELSE sure END AS conf, row_number() OVER (PARTITION BY trip_id, segment_id, window_no ORDER BY sc DESC, i) AS o FROM r1),
rk AS (SELECT a.trip_id, a.segment_id, a.window_no, a.start_t, a.end_t, a.ty AS anomaly_type, {tidy_sql("a.sc", 4)} AS risk_score, CASE WHEN a.sc >= 0.9 THEN 'High' WHEN a.sc >= 0.4129 THEN 'Medium' ELSE 'Low' END AS risk_level, {tidy_sql("a.conf", 4)} AS confidence,
 b.ty AS secondary_type, {tidy_sql("b.sc", 4)} AS secondary_score, {tidy_sql("b.conf", 4)} AS secondary_confidence, a.top, {_keyed("a.ty").replace("top", "a.top").replace("(vs,", "(a.vs,")} AS keyed, {_keyed("b.ty").replace("top", "a.top").replace("(vs,", "(a.vs,")} AS keyed2, a.vs,
 concat_ws('; ', CASE WHEN a.v_accel_pedal_channel_delta IS NULL THEN 'no pair of pedal readings in the window: its score is 0' END,
  CASE WHEN (a.i = 3 AND a.sc > 0) OR (b.i = 3 AND b.sc > 0) THEN 'intake_air_temperature_sensor_fault: decided by ' || a.c4 END, CASE WHEN (a.i = 4 AND a.sc > 0) OR (b.i = 4 AND b.sc > 0) THEN 'map_load_signal_plausibility_fault: decided by ' || a.c5 END) AS notes
 FROM r2 a JOIN r2 b ON a.trip_id = b.trip_id AND a.segment_id = b.segment_id AND a.window_no = b.window_no AND a.o = 1 AND b.o = 2)"""
SCORED = (*DECIDED, _WIN, _RISK)


def risks(spark, sf_dir):
    df = samples(spark, sf_dir)
    return s.risk_records(s.component_scores(s.with_forwarded(written(_windows(df), "windows"), _forwarded(df))))


@query(
    with_ticks(*SCORED)
    + """SELECT trip_id, segment_id, window_no, start_t, end_t, anomaly_type, risk_score, risk_level, confidence, secondary_type, secondary_score, secondary_confidence, array_to_string(top, ',') AS top_signals,
 array_to_string(keyed, ',') AS key_signals, list_transform(keyed, lambda x: CAST(round(CAST(map_extract(vs, x)[1] AS DECIMAL(32, 9)), 4) AS DOUBLE)) AS key_values, array_to_string(keyed2, ',') AS secondary_key_signals, notes FROM rk"""
)
def m01_to_m06_window_risk(spark, sf_dir):
    r = risks(spark, sf_dir)
    two = F.col("secondary_risk")
    names = lambda x: F.array_join(F.transform(x, lambda y: y["feature"]), ",")
    return r.select(
        *s.WINDOW, "start_t", "end_t", "anomaly_type", "risk_score", "risk_level", F.col("prediction_confidence").alias("confidence"), two["anomaly_type"].alias("secondary_type"), two["risk_score"].alias("secondary_score"),
        two["prediction_confidence"].alias("secondary_confidence"), F.array_join("top_signals", ",").alias("top_signals"), names("key_signals").alias("key_signals"),
        F.transform("key_signals", lambda y: y["value"]).alias("key_values"), names(two["key_signals"]).alias("secondary_key_signals"), F.array_join("notes", "; ").alias("notes"),
    )


@query(
    with_ticks(PROD, _WIN, "u AS (" + " UNION ALL ".join(f"SELECT trip_id, segment_id, window_no, '{c}' AS signal, mean_{c} AS mean_error, max_{c} AS max_error FROM ws" for c in s.FORECAST) + ")")
    + "SELECT trip_id, segment_id, window_no, signal, CAST(round(CAST(mean_error AS DECIMAL(32, 9)), 6) AS DOUBLE) AS mean_error, CAST(round(CAST(max_error AS DECIMAL(32, 9)), 6) AS DOUBLE) AS max_error FROM u"
)
def a14_m01_j13_residual_summary(spark, sf_dir):
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), tidy(F.col(f"mean_{c}"), 6).alias("mean_error"), tidy(F.col(f"max_{c}"), 6).alias("max_error")) for c in s.FORECAST]))
    return _windows(prod(spark, sf_dir)).select(*s.WINDOW, cells.alias("c")).select(*s.WINDOW, "c.*")


@query(with_ticks(PROD, _WIN) + "SELECT trip_id, segment_id, window_no, " + ", ".join(f"{tidy_sql('v_' + v, 5)} AS {v}" for v in _V) + " FROM ws")
def a15_window_values(spark, sf_dir):
    return _windows(prod(spark, sf_dir)).select(*s.WINDOW, *[tidy(F.col(f"v_{v}"), 5).alias(v) for v in _V])


@query(
    with_ticks(*SCORED, "q AS (SELECT trip_id, segment_id, window_no, unnest(keyed) AS feature, vs FROM rk)")
    + """SELECT trip_id, segment_id, window_no, feature, CAST(round(CAST(map_extract(vs, feature)[1] AS DECIMAL(32, 9)), 4) AS DOUBLE) AS value,
 CASE feature WHEN 'rpm' THEN 'RPM' WHEN 'speed' THEN 'km/h' WHEN 'coolant_temp' THEN '°C' WHEN 'map' THEN 'kPa' WHEN 'maf' THEN 'g/s' WHEN 'tps' THEN '%' WHEN 'accel_pedal_d' THEN '%' WHEN 'accel_pedal_e' THEN '%' WHEN 'accel_pedal_channel_delta' THEN 'pp'
  WHEN 'ect_rate_180s' THEN '°C/min' WHEN 'intake_temp' THEN '°C' WHEN 'ambient_temp' THEN '°C' WHEN 'intake_ambient_delta' THEN '°C' WHEN 'speed_density_maf_residual' THEN 'g/s' WHEN 'rpm_slope' THEN 'RPM/s' WHEN 'maf_integral_180s' THEN 'g'
  WHEN 'intake_temp_stability' THEN '°C' WHEN 'map_range_60s' THEN 'kPa' WHEN 'pedal_slope' THEN 'pp/s' END AS unit,
 CASE WHEN CAST(round(CAST(map_extract(vs, feature)[1] AS DECIMAL(32, 9)), 4) AS DOUBLE) BETWEEN lo AND hi THEN 'NORMAL' ELSE 'ABNORMAL' END AS status FROM q JOIN (SELECT * FROM (VALUES ('rpm', 0, 3682), ('speed', 0, 218), ('coolant_temp', 90, 95), ('map', 36, 237), ('maf', 0, 123), ('tps', 0, 89),
 ('accel_pedal_d', 0, 100), ('accel_pedal_e', 0, 100), ('accel_pedal_channel_delta', 0, 10), ('ect_rate_180s', 0, 2), ('intake_temp', -3, 41), ('ambient_temp', -7, 25), ('intake_ambient_delta', 0, 20), ('speed_density_maf_residual', -20, 20), ('rpm_slope', -120, 135),
 ('maf_integral_180s', 0, 2500), ('intake_temp_stability', 0, 5), ('map_range_60s', 0, 80), ('pedal_slope', -2.4, 2.4)) AS g(feature, lo, hi)) g USING (feature)"""
)
def x21_x22_s14_p14_key_signals(spark, sf_dir):
    each = risks(spark, sf_dir).select(*s.WINDOW, F.explode("key_signals").alias("k"))
    return each.select(*s.WINDOW, "k.feature", "k.value", "k.unit", signal_status(F.col("k.value"), F.col("k.reference_range")).alias("status"))


@query(
    with_ticks(*SCORED)
    + """SELECT anomaly_type, risk_level, CASE WHEN risk_level IN ('Medium', 'High') THEN TRUE ELSE FALSE END AS affected, count(*) AS windows, count(DISTINCT trip_id) AS trips, count(DISTINCT segment_id) AS segments, max(risk_score) AS worst FROM rk GROUP BY ALL"""
)
def m06_p15_batch_summary(spark, sf_dir):
    r = risks(spark, sf_dir).withColumn("affected", s.is_affected(F.col("risk_level"), F.col("risk_score")))
    return r.groupBy("anomaly_type", "risk_level", "affected").agg(F.count("*").alias("windows"), F.count_distinct("trip_id").alias("trips"), F.count_distinct("segment_id").alias("segments"), F.max("risk_score").alias("worst"))


@query(
    with_ticks(*SCORED, "c AS (SELECT anomaly_type AS component, trip_id, start_t, risk_score FROM rk UNION ALL SELECT secondary_type, trip_id, start_t, secondary_score FROM rk)")
    + "SELECT component, count(*) AS windows, max(risk_score) AS worst, arg_max(trip_id, (risk_score, -start_t, trip_id)) AS worst_trip, CAST(sum(CAST(round(risk_score * 10000) AS HUGEINT)) AS DOUBLE) / (count(*) * 10000.0) AS mean FROM c GROUP BY component"
)
def m07_m16_t05_t06_component_rollup(spark, sf_dir):
    r = risks(spark, sf_dir)
    both = r.select(F.explode(F.array(F.struct("anomaly_type", "risk_score"), F.struct("secondary_risk.anomaly_type", "secondary_risk.risk_score"))).alias("c"), "trip_id", "start_t")
    return both.groupBy(F.col("c.anomaly_type").alias("component")).agg(
        F.count("*").alias("windows"), F.max("c.risk_score").alias("worst"), F.max_by("trip_id", F.struct("c.risk_score", -F.col("start_t"), "trip_id")).alias("worst_trip"), steady_mean(F.col("c.risk_score"), 4).alias("mean")
    )


_HIST = "h AS (SELECT event_type AS component, trip_id, us AS t, least(greatest(value / 100, 0), 1) AS risk_score FROM irregular WHERE value IS NOT NULL)"


def _history(spark, sf_dir):
    v = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    return irregular(spark, sf_dir).where("value is not null").select(F.col("event_type").alias("component"), "trip_id", F.col("us").alias("t"), v.alias("risk_score"))


_TRIP = """tp AS (SELECT component, trip_id, min(t) AS t, CAST(sum(CAST(round(risk_score * 1e9) AS HUGEINT)) AS DOUBLE) / (count(*) * 1e9) AS risk, count(*) AS windows FROM h GROUP BY component, trip_id),
tc AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY t, trip_id) - 1 AS cycle FROM tp)"""


@query(with_irregular(_HIST, _TRIP) + "SELECT component, trip_id, t, risk, windows, CAST(cycle AS BIGINT) AS cycle FROM tc")
def a13_w36_trip_risk(spark, sf_dir):
    return s.trip_risk(_history(spark, sf_dir), "component")


@query(
    with_irregular(_HIST, _TRIP, "rg AS (SELECT component, count(*) AS n, regr_slope(risk, cycle) AS slope, regr_intercept(risk, cycle) AS icpt, arg_max(risk, cycle) AS last FROM tc GROUP BY component)")
    + """SELECT component, n AS trips, round(slope, 8) AS slope, round(icpt, 8) AS intercept,
 CAST(CASE WHEN last >= 0.9 THEN 0 WHEN slope > 0 AND ceil((0.9 - last) / slope - 1e-12) <= 50 THEN ceil((0.9 - last) / slope - 1e-12) END AS INTEGER) AS cycles FROM rg"""
)
def m08_trend_projection(spark, sf_dir):
    return s.project(s.trip_risk(_history(spark, sf_dir), "component"), "component").drop("probability")


def _cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0))))"
    tail = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({z}) * ({z}) / 2))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} / 2 ELSE {tail} / 2 END"


@query(
    with_irregular(
        _HIST, _TRIP,
        "rg AS (SELECT component, count(*) AS n, regr_slope(risk, cycle) AS slope, regr_intercept(risk, cycle) AS icpt, regr_sxx(risk, cycle) AS sxx, regr_syy(risk, cycle) AS syy, regr_sxy(risk, cycle) AS sxy, avg(cycle) AS mx, arg_max(risk, cycle) AS last, max(cycle) AS lx FROM tc GROUP BY component)",
        "pr AS (SELECT *, icpt + slope * (lx + 10) AS mean, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) * sqrt(1 + 1 / n + (lx + 10 - mx) * (lx + 10 - mx) / sxx) AS se FROM rg)", "pz AS (SELECT *, (0.9 - mean) / nullif(se, 0) AS z FROM pr)",
    )
    + f"""SELECT component, n AS trips, CASE WHEN n >= 5 THEN round(slope, 8) END AS slope, CASE WHEN n >= 5 THEN round(icpt, 8) END AS intercept,
 CASE WHEN n < 5 THEN NULL WHEN last >= 0.9 THEN 1.0 WHEN se < 1e-12 THEN CASE WHEN mean >= 0.9 THEN 1.0 ELSE 0.0 END ELSE round(least(greatest(1 - ({_cdf_sql("z")}), 0), 1), 4) END AS probability,
 CAST(CASE WHEN n < 5 THEN NULL WHEN last >= 0.9 THEN 0 WHEN slope > 0 AND ceil((0.9 - last) / slope - 1e-12) <= 50 THEN ceil((0.9 - last) / slope - 1e-12) END AS INTEGER) AS cycles FROM pz"""
)
def m08_trend_probability(spark, sf_dir):
    return s.project(s.trip_risk(_history(spark, sf_dir), "component"), "component")


_DEC = """dc AS (SELECT printf('trip_%04d', l_suppkey) AS trip_id, CASE WHEN l_orderkey % 3 = 0 THEN printf('trip_%04d_seg_%03d', l_suppkey, l_orderkey % 4) END AS segment_id, CASE WHEN l_orderkey % 3 = 0 THEN 'segment_first_row' ELSE 'trip' END AS unit_scope,
 CASE l_orderkey % 2 WHEN 0 THEN 'intake_air_temperature_sensor_fault' ELSE 'map_load_signal_plausibility_fault' END AS proxy_id, CASE WHEN l_quantity > 48 THEN 'triggered' ELSE 'pass' END AS result_state,
 CASE l_partkey % 5 WHEN 0 THEN 'verdict' WHEN 1 THEN 'observation' ELSE 'support' END AS decision_role, l_partkey % 35 = 0 AS dtc_emitted, l_partkey % 11 = 0 AS confidence_capped_low, CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'provisional' END AS confidence,
 CASE WHEN l_linenumber = 7 THEN '5-S2' ELSE 'c' || (l_partkey % 9) END AS sub_check_id, CASE l_partkey % 4 WHEN 0 THEN 'P0101' WHEN 1 THEN 'P0106' END AS routed_dtc FROM lineitem),
wi AS (SELECT trip_id, segment_id, CAST(floor((row_in_segment - 1) / 60) AS INTEGER) AS window_no FROM ticks GROUP BY ALL HAVING count(*) = 60)"""


@query(
    with_ticks(
        _DEC,
        """cv AS (SELECT w.*, d.sub_check_id, CASE WHEN decision_role = 'verdict' THEN CASE WHEN dtc_emitted THEN 0.9 ELSE 0.6 END WHEN decision_role = 'support' THEN 0.5 END AS level,
 CASE WHEN confidence_capped_low THEN 0.35 WHEN confidence = 'high' THEN 0.9 WHEN confidence = 'provisional' THEN 0.6 ELSE 0.35 END AS how
 FROM wi w JOIN dc d ON w.trip_id = d.trip_id AND (d.segment_id IS NULL OR d.unit_scope <> 'segment_first_row' OR d.segment_id = w.segment_id)
 WHERE proxy_id = 'intake_air_temperature_sensor_fault' AND result_state = 'triggered' AND decision_role <> 'observation' AND NOT (sub_check_id = '5-S2' AND routed_dtc IS NOT NULL AND routed_dtc <> 'P0106'))""",
        "mx AS (SELECT trip_id, segment_id, window_no, max(level) AS level FROM cv GROUP BY ALL)",
        "bs AS (SELECT trip_id, segment_id, window_no, level, min(how) AS how, string_agg(DISTINCT sub_check_id, ', ' ORDER BY sub_check_id) AS checks FROM cv JOIN mx USING (trip_id, segment_id, window_no, level) GROUP BY ALL)",
    )
    + "SELECT trip_id, segment_id, window_no, CAST(coalesce(level, 0) AS DOUBLE) AS score, CAST(coalesce(how, 0.35) AS DOUBLE) AS confidence, coalesce(checks, '') AS checks FROM wi LEFT JOIN bs USING (trip_id, segment_id, window_no)"
)
def m04_j06_forward(spark, sf_dir):
    """All lines as decisions of their suppliers' trips, over all whole windows of 60 rows."""
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    first = k % 3 == 0
    d = table(spark, sf_dir, "lineitem").select(
        F.format_string("trip_%04d", "l_suppkey").alias("trip_id"), F.when(first, F.format_string("trip_%04d_seg_%03d", F.col("l_suppkey"), k % 4)).alias("segment_id"), F.when(first, "segment_first_row").otherwise("trip").alias("unit_scope"),
        F.when(k % 2 == 0, s.FORWARDED[0]).otherwise(s.FORWARDED[1]).alias("proxy_id"), F.when(F.col("l_quantity") > 48, "triggered").otherwise("pass").alias("result_state"),
        F.when(p % 5 == 0, "verdict").when(p % 5 == 1, "observation").otherwise("support").alias("decision_role"), (p % 35 == 0).alias("dtc_emitted"), (p % 11 == 0).alias("confidence_capped_low"),
        F.when(p % 3 == 0, "high").when(p % 3 == 1, "provisional").alias("confidence"), F.when(F.col("l_linenumber") == 7, "5-S2").otherwise(F.concat(F.lit("c"), (p % 9).cast("string"))).alias("sub_check_id"),
        F.when(p % 4 == 0, "P0101").when(p % 4 == 1, "P0106").alias("routed_dtc"),
    )
    w = tumble_rows(ticks(spark, sf_dir), 60).select(*s.WINDOW).distinct()
    return s.forward(d, w, s.FORWARDED[0])


_TYPES = ("click", "view", "purchase")
_REC = """rc AS (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END END AS expected, event_type AS anomaly_type,
 least(greatest(CAST(value AS DOUBLE) / 100, 0), 1) AS risk_score, event_id % 5 AS severity FROM events WHERE value IS NOT NULL)"""


def _records(spark, sf_dir):
    k = F.col("event_id") % 4
    return table(spark, sf_dir, "events").where("value is not null").select(
        "event_id", F.when(k == 0, "click").when(k == 1, "view").when(k == 2, "purchase").alias("expected"), F.col("event_type").alias("anomaly_type"),
        F.least(F.greatest(F.col("value").cast("double") / 100, F.lit(0.0)), F.lit(1.0)).alias("risk_score"), (F.col("event_id") % 5).alias("severity"),
    )


def _scored(spark, sf_dir, threshold=0.4129):
    return _records(spark, sf_dir).withColumn("predicted", F.when(F.col("risk_score") >= threshold, F.col("anomaly_type")).otherwise("no_alarm"))


_M = """mt AS (SELECT threshold, ty AS type, count(*) FILTER (predicted = ty AND expected IS NOT DISTINCT FROM ty) AS tp, count(*) FILTER (predicted = ty AND expected IS DISTINCT FROM ty) AS fp, count(*) FILTER (predicted <> ty AND expected = ty) AS fn
 FROM pr, (SELECT unnest(['click', 'view', 'purchase']) AS ty) GROUP BY ALL),
mf AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM mt)"""
_PR = "pr AS (SELECT *, 0.4129 AS threshold, CASE WHEN risk_score >= 0.4129 THEN anomaly_type ELSE 'no_alarm' END AS predicted FROM rc)"


@query(f"WITH {_REC}, {_PR}, {_M} SELECT type, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM mf")
def a18_m10_classification_metrics(spark, sf_dir):
    m = e.classification_metrics(_scored(spark, sf_dir), _TYPES)
    return m.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"WITH {_REC}, {_PR} SELECT expected, " + ", ".join(f"count(*) FILTER (predicted = '{t}') AS {t}" for t in (*_TYPES, "no_alarm")) + " FROM pr GROUP BY expected")
def a19_confusion(spark, sf_dir):
    return e.confusion(_scored(spark, sf_dir), (*_TYPES, "no_alarm"))


@query(
    f"WITH {_REC}, {_PR} SELECT expected, severity, count(*) AS runs, count(*) FILTER (predicted = expected) AS hits, round(avg(CASE WHEN predicted <> 'no_alarm' THEN 1.0 ELSE 0.0 END), 9) AS alarm_rate, CAST(sum(CAST(round(risk_score * 1e9) AS HUGEINT)) AS DOUBLE) / (count(*) * 1e9) AS mean_risk FROM pr WHERE expected IS NOT NULL GROUP BY ALL"
)
def a20_severity_curve(spark, sf_dir):
    return _scored(spark, sf_dir).where("expected is not null").groupBy("expected", "severity").agg(
        F.count("*").alias("runs"), F.count_if(F.col("predicted") == F.col("expected")).alias("hits"), F.round(F.avg((F.col("predicted") != "no_alarm").cast("double")), 9).alias("alarm_rate"), steady_mean(F.col("risk_score")).alias("mean_risk")
    )


@query(f"WITH {_REC}, l AS (SELECT expected, CASE WHEN risk_score >= 0.9 THEN 'High' WHEN risk_score >= 0.4129 THEN 'Medium' ELSE 'Low' END AS l FROM rc) SELECT expected, count(*) FILTER (l = 'High') AS high, count(*) FILTER (l = 'Medium') AS medium, count(*) FILTER (l = 'Low') AS low FROM l GROUP BY expected")
def a21_x19_level_distribution(spark, sf_dir):
    level = risk_level(F.col("risk_score"))
    return _records(spark, sf_dir).groupBy("expected").agg(*[F.count_if(level == x).alias(x.lower()) for x in ("High", "Medium", "Low")])


@query(
    f"""WITH {_REC}, th AS (SELECT unnest([0.2, 0.4129, 0.6, 0.8]) AS threshold), pr AS (SELECT rc.*, threshold, CASE WHEN risk_score >= threshold THEN anomaly_type ELSE 'no_alarm' END AS predicted FROM rc, th), {_M},
 h AS (SELECT threshold, avg(CASE WHEN predicted <> 'no_alarm' THEN 1.0 ELSE 0.0 END) AS fpr FROM pr WHERE expected IS NULL GROUP BY threshold),
 sw AS (SELECT mf.threshold, avg(f1) AS macro_f1, any_value(fpr) AS fpr FROM mf JOIN h ON mf.threshold = h.threshold GROUP BY mf.threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(macro_f1, 9) AS macro_f1, round(fpr, 9) AS fpr, row_number() OVER (ORDER BY (fpr <= 0.5) DESC, macro_f1 DESC, threshold) = 1 AS chosen FROM sw"""
)
def m11_t08_threshold_sweep(spark, sf_dir):
    th = spark.createDataFrame([(x,) for x in (0.2, 0.4129, 0.6, 0.8)], "threshold double")
    sw = e.threshold_sweep(_records(spark, sf_dir), th, _TYPES)
    w = Window.orderBy((F.col("fpr") <= 0.5).desc(), F.desc("macro_f1"), "threshold")  # a row a threshold
    return sw.withColumn("chosen", F.row_number().over(w) == 1).withColumns({c: F.round(c, 9) for c in ("macro_f1", "fpr")})


@query(
    f"""WITH {_REC}, a AS (SELECT severity, count(*) AS n, count(*) FILTER (risk_score >= 0.4129) AS k FROM rc WHERE expected IS NULL GROUP BY severity), c AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM a)
SELECT severity, n, k, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 6) AS lo, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 6) AS hi FROM c"""
)
def a22_x14_wilson(spark, sf_dir):
    a = _records(spark, sf_dir).where("expected is null").groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("risk_score") >= 0.4129).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return a.withColumns({"lo": F.round(lo, 6), "hi": F.round(hi, 6)})


@query(
    """WITH s AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS r FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_custkey, CASE WHEN r % 3 = 0 THEN 'hold_out' ELSE 'calibration' END AS role, CAST(('0x' || substr(md5(concat_ws(':', 'split', o_custkey)), 1, 8)) AS BIGINT) % 5 = 0 AS validation FROM s"""
)
def m12_splits(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    r = F.col("number")
    return numbered(c, ("o_custkey",)).select("o_custkey", F.when(r % 3 == 0, "hold_out").otherwise("calibration").alias("role"), (draw(F.lit("split"), F.col("o_custkey")) % 5 == 0).alias("validation"))


@query(
    with_ticks(
        "n AS (SELECT trip_id, count(*) AS n FROM ticks WHERE maf IS NOT NULL GROUP BY trip_id)", "w AS (SELECT maf AS v, sum(1 / (n * (SELECT count(*) FROM n))) AS w FROM ticks JOIN n USING (trip_id) WHERE maf IS NOT NULL GROUP BY maf)",
        "c AS (SELECT *, sum(w) OVER (ORDER BY v) AS c FROM w)", "b AS (SELECT max(c) FILTER (c <= 0.95) AS lc, arg_max(v, c) FILTER (c <= 0.95) AS lv, min(c) FILTER (c >= 0.95) AS hc, arg_min(v, c) FILTER (c >= 0.95) AS hv FROM c)",
    )
    + "SELECT round(lv + (hv - lv) * (0.95 - lc) / (hc - lc), 6) AS quantile FROM b"
)
def a10_weighted_quantile(spark, sf_dir):
    return e.weighted_quantile(ticks(spark, sf_dir), "maf", 0.95).withColumn("quantile", F.round("quantile", 6))


@query(
    with_ticks("m AS (SELECT trip_id, quantile_cont(maf, 0.5) AS m FROM ticks GROUP BY trip_id)", "l AS (SELECT a.trip_id AS left_out_trip, quantile_cont(b.m, 0.5) AS r FROM m a JOIN m b ON a.trip_id <> b.trip_id GROUP BY a.trip_id)")
    + "SELECT left_out_trip, round(r, 6) AS recalculated, round(r - 30, 6) AS deviation, round((r - 30) / 30 * 100, 4) AS deviation_pct, abs(r - 30) <= 10 AS passes FROM l"
)
def c04_a08_leave_one_out(spark, sf_dir):
    df = e.leave_one_out_median(ticks(spark, sf_dir), "maf", 30.0, 10.0)
    return df.withColumns({"recalculated": F.round("recalculated", 6), "deviation": F.round("deviation", 6), "deviation_pct": F.round("deviation_pct", 4)})


@query(
    with_ticks(
        "p AS (SELECT *, row_number() OVER (ORDER BY trip_id) - 1 AS i FROM (SELECT trip_id, avg(maf) AS m FROM ticks GROUP BY trip_id))",
        "d AS (SELECT it, CAST(('0x' || substr(md5(concat_ws(':', 'boot', it, i)), 1, 8)) AS BIGINT) % (SELECT count(*) FROM p) AS pick FROM p, range(1, 201) t(it))",
        "b AS (SELECT it, avg(m) AS mean FROM d JOIN p ON p.i = d.pick GROUP BY it)",
    )
    + "SELECT round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS std, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi, count(*) AS iterations FROM b"
)
def c05_bootstrap(spark, sf_dir):
    return e.bootstrap_mean(ticks(spark, sf_dir), "maf", 200).withColumns({c: F.round(c, 6) for c in ("mean", "std", "lo", "hi")})


@query(
    with_ticks(f"o AS (SELECT *, sum(CASE WHEN coalesce(maf = 0, FALSE) THEN 0 ELSE 1 END) OVER ({SEG}) AS o FROM ticks)", "g AS (SELECT trip_id, o, segment_id, count(*) FILTER (maf = 0) AS n FROM o GROUP BY ALL)", "l AS (SELECT trip_id, max(n) AS longest FROM g GROUP BY trip_id)")
    + "SELECT CAST(c AS INTEGER) AS candidate, count(*) AS trips, count(*) FILTER (longest >= c) AS triggered, max(longest) AS longest FROM l, (SELECT unnest([5, 10, 12, 15]) AS c) GROUP BY c"
)
def c06_grid(spark, sf_dir):
    return e.grid_runs(longest_runs(ticks(spark, sf_dir), F.col("maf") == 0), (5, 10, 12, 15))


@query(
    with_ticks()
    + """SELECT child_state, round(regr_slope(maf, least(greatest(rpm, 877.0), 2205.0)), 8) AS slope, round(regr_intercept(maf, least(greatest(rpm, 877.0), 2205.0)), 6) AS intercept, round(regr_r2(maf, least(greatest(rpm, 877.0), 2205.0)), 6) AS r2
FROM ticks WHERE rpm IS NOT NULL GROUP BY child_state"""
)
def a11_c02_fit_line(spark, sf_dir):
    return e.fit_line(ticks(spark, sf_dir), "rpm", "maf", 877.0, 2205.0, "child_state").withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 6), "r2": F.round("r2", 6)})


@query(
    with_ticks("q AS (SELECT 'maf_p99_5' AS chk, 66.0 AS frozen, quantile_cont(maf, 0.995) AS rederived FROM ticks UNION ALL SELECT 'map_max', 190.0, max(map) FROM ticks UNION ALL SELECT 'rpm_min', 0.0, min(rpm) FROM ticks)", "v AS (SELECT *, abs(rederived - frozen) / greatest(abs(frozen), 1e-12) AS d FROM q)")
    + "SELECT chk, CAST(frozen AS DOUBLE) AS frozen, round(rederived, 6) AS rederived, round(d, 6) AS deviation, CASE WHEN d IS NULL THEN 'INCOMPLETE' WHEN d <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v"
)
def c01_a09_audit(spark, sf_dir):
    df = ticks(spark, sf_dir)
    high = exact_quantiles(df.withColumn("of", F.lit("all")), ("of",), "maf", (0.995,)).select(F.col("q")[0].alias("maf_p99_5"))
    a = df.agg(F.max("map").alias("map_max"), F.min("rpm").alias("rpm_min")).crossJoin(high)  # one row each
    long = a.unpivot([], ["maf_p99_5", "map_max", "rpm_min"], "chk", "rederived")
    frozen = F.when(F.col("chk") == "maf_p99_5", 66.0).when(F.col("chk") == "map_max", 190.0).otherwise(0.0)
    out = e.audit(long.withColumn("frozen", frozen), 0.01)
    return out.select("chk", "frozen", F.round("rederived", 6).alias("rederived"), F.round("deviation", 6).alias("deviation"), "verdict")


_HELD = "row_in_segment BETWEEN 20 AND 60"
_INJ = {
    "set_constant": ("coolant_temp", {"value": 112.0}, "112.0"), "add_offset": ("coolant_temp", {"offset": 15.0}, "coolant_temp + 15.0"), "multiply": ("maf", {"factor": 0.7}, "maf * 0.7"),
    "freeze_to_first": ("intake_temp", {}, "first_value(intake_temp) OVER h"), "linear_ramp": ("coolant_temp", {"start": 90.0, "rate_per_min": 6.0}, "90.0 + (row_number() OVER h - 1) * 0.1"),
    "cap_max": ("map", {"value": 120.0}, "CASE WHEN map IS NOT NULL THEN least(map, 120.0) END"), "relative_offset": ("accel_pedal_e", {"reference": "accel_pedal_d", "offset": 20.0}, "accel_pedal_d + 20.0"),
}


@query(
    with_ticks(f"hd AS (SELECT *, {_HELD} AS held FROM ticks)")
    + f"SELECT {KEYS}, "
    + ", ".join(f"round(CASE WHEN held THEN {sql} ELSE {sig} END, 6) AS {n}" for n, (sig, _, sql) in _INJ.items())
    + " FROM hd WINDOW h AS (PARTITION BY trip_id, segment_id, held ORDER BY row_in_segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def i05_i07_inject(spark, sf_dir):
    df = ticks(spark, sf_dir).withColumn("held", F.col("row_in_segment").between(20, 60))
    w = Window.partitionBy("trip_id", "segment_id", "held").orderBy("row_in_segment")
    return df.select(*KEY, *[F.round(e.inject(df, sig, n, F.col("held"), p, w), 6).alias(n) for n, (sig, p, _) in _INJ.items()])


@query(
    with_ticks(f"b AS (SELECT *, lag(map) OVER ({SEG}) AS l1, lag(map, 2) OVER ({SEG}) AS l2, lag(map, 3) OVER ({SEG}) AS l3 FROM ticks)")
    + f"SELECT {KEYS}, coalesce(CASE WHEN row_in_segment % 40 = 10 THEN l1 WHEN row_in_segment % 40 = 11 AND row_in_segment > 10 THEN l2 WHEN row_in_segment % 40 = 12 AND row_in_segment > 10 THEN l3 END, map) AS map FROM b"
)
def i05_suppress_step(spark, sf_dir):
    df = ticks(spark, sf_dir)
    return df.select(*KEY, e.inject(df, "map", "suppress_step", F.col("row_in_segment") % 40 == 10, {}, segment_window()).alias("map"))


@query(
    """WITH c AS (SELECT unnest(['cooling', 'maf', 'pedal']) AS family, unnest([[5, 10, 15], [10, 20, 30], [10, 20, 30]]) AS grid), s AS (SELECT family, unnest(grid) AS severity FROM c)
SELECT family, CAST(severity AS BIGINT) AS severity, trip, family || '_' || severity || '_' || trip AS scenario FROM s, (SELECT DISTINCT l_suppkey AS trip FROM lineitem)"""
)
def i01_i08_scenarios(spark, sf_dir):
    cases = spark.createDataFrame([("cooling", [5, 10, 15]), ("maf", [10, 20, 30]), ("pedal", [10, 20, 30])], "family string, grid array<bigint>").select("family", F.explode("grid").alias("severity"))
    trips = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trip")).distinct()
    j = trips.crossJoin(F.broadcast(cases))  # a fixed table of nine cases
    return j.withColumn("scenario", F.concat_ws("_", "family", F.col("severity").cast("string"), F.col("trip").cast("string")))


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice = 0 THEN 0 ELSE round(o_totalprice * pow(10, 5 - floor(log10(abs(o_totalprice)))), 0) / pow(10, 5 - floor(log10(abs(o_totalprice)))) END, 4) AS sig6, CASE WHEN p > 0 AND p < 0.01 THEN '<1%' ELSE CAST(CAST(round(p * 100, 0) AS INTEGER) AS VARCHAR) || '%' END AS pct FROM (SELECT *, (o_orderkey % 997) / 997.0 AS p FROM orders)")
def x17_x18_rounding(spark, sf_dir):
    p = F.col("o_orderkey") % 997 / 997.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(round_significant(F.col("o_totalprice"), 6), 4).alias("sig6"), percent_text(p).alias("pct"))


@query(f"SELECT o_orderkey, round({_cdf_sql('z')}, 4) AS cdf FROM (SELECT o_orderkey, (o_orderkey % 8001) / 1000 - 4 AS z FROM orders)")
def x16_norm_cdf(spark, sf_dir):
    z = (F.col("o_orderkey") % 8001) / 1000 - 4
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(norm_cdf(z), 4).alias("cdf"))


@query(
    with_irregular(
        _HIST, _TRIP, "rg AS (SELECT component, count(*) AS n, regr_slope(risk, cycle) AS slope, arg_max(risk, cycle) AS last FROM tc GROUP BY component)",
        "es AS (SELECT component, n, CASE WHEN last >= 0.9 THEN 0 WHEN slope > 0 AND ceil((0.9 - last) / slope - 1e-12) <= 50 THEN ceil((0.9 - last) / slope - 1e-12) END AS cycles FROM rg)",
    )
    + """SELECT h.component, h.trip_id, h.t, CAST(cycles AS INTEGER) AS cycles, concat_ws('; ', CASE WHEN risk_score >= 0.9 THEN 'current window is High' END, CASE WHEN n < 5 THEN 'too few trips' WHEN cycles IS NULL THEN 'no crossing projected' END) AS notes
FROM h JOIN es USING (component)"""
)
def m09_annotated_records(spark, sf_dir):
    h = _history(spark, sf_dir)
    est = s.project(s.trip_risk(h, "component"), "component").select("component", "trips", "cycles")  # a row a component
    j = h.join(est, "component")
    late = F.when(F.col("trips") < 5, "too few trips").when(F.col("cycles").isNull(), "no crossing projected")
    notes = F.array_union(F.array_compact(F.array(F.when(F.col("risk_score") >= 0.9, "current window is High"))), F.array_compact(F.array(late)))
    return j.select("component", "trip_id", "t", "cycles", F.array_join(notes, "; ").alias("notes"))


@query(
    with_ticks(f"n AS (SELECT *, row_number() OVER ({SEG}) AS r, count(*) OVER (PARTITION BY trip_id, segment_id) AS n FROM ticks)")
    + "SELECT CASE WHEN ('0x' || substr(md5(concat_ws(':', 'part', trip_id)), 1, 8))::BIGINT % 4 = 0 THEN 'validation' ELSE 'train' END AS part, count(DISTINCT trip_id) AS trips, count(DISTINCT segment_id) AS segments, count(*) AS rows, count(*) FILTER (r % 32 = 1 AND r + 127 <= n) AS windows FROM n GROUP BY ALL"
)
def m15_split_summary(spark, sf_dir):
    df = ticks(spark, sf_dir)
    part = F.when(draw(F.lit("part"), F.col("trip_id")) % 4 == 0, "validation").otherwise("train")
    r, n = F.row_number().over(segment_window()), F.count("*").over(Window.partitionBy("trip_id", "segment_id"))
    df = df.select(part.alias("part"), "trip_id", "segment_id", ((r % 32 == 1) & (r + 127 <= n)).alias("starts"))
    return df.groupBy("part").agg(F.count_distinct("trip_id").alias("trips"), F.count_distinct("segment_id").alias("segments"), F.count("*").alias("rows"), F.count_if("starts").alias("windows"))


@query(with_irregular(_HIST, _TRIP) + "SELECT component, printf('%s#%03d', trip_id, cycle) AS label, risk, CASE WHEN risk >= 0.9 THEN 'High' WHEN risk >= 0.4129 THEN 'Medium' ELSE 'Low' END AS level FROM tc")
def m17_upload_history(spark, sf_dir):
    t = s.trip_risk(_history(spark, sf_dir), "component")
    return t.select("component", F.format_string("%s#%03d", "trip_id", "cycle").alias("label"), "risk", risk_level(F.col("risk")).alias("level"))
