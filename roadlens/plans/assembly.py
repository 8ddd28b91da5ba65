"""Queries of the production table and of the contracts of what is made from it (J-04, V-01, V-02, V-10, V-13, V-15, V-17 to V-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import assembly as a
from roadlens.operators import features as f
from roadlens.operators import gates as g
from roadlens.operators.starts import start_episodes
from roadlens.plans.registry import query
from roadlens.plans.rules import DECIDED, LENGTHS, PROD, all_decisions, samples
from roadlens.plans.scoring import SCORED, risks
from roadlens.plans.sql import tidy_sql, with_ticks
from roadlens.plans.starts import CTX, EP
from roadlens.sources.adapters import table, ticks
from roadlens.sources.scratch import written

_GAPS = "gq AS (SELECT trip_id, segment_id, a, CASE WHEN a - lag(z) OVER (ORDER BY a, trip_id, segment_id) >= 0 THEN CAST(a - lag(z) OVER (ORDER BY a, trip_id, segment_id) AS DOUBLE) END AS gap FROM (SELECT trip_id, segment_id, min(t) AS a, max(t) AS z FROM ticks GROUP BY ALL))"
_ROUNDED = {"coolant_ambient_delta": 6, "intake_ambient_delta": 6, "accel_pedal_mean": 6, "accel_pedal_channel_delta": 6, "pedal_slope": 6, "rpm_slope": 6, "speed_density_maf_residual": 5, "pedal_mapping_residual": 5} | dict.fromkeys(a.WINDOWS, 4)
_TABLE = """tb AS (SELECT p.t AS timestamp, p.trip_id, p.segment_id, p.row_in_segment, 1.0::DOUBLE AS dt_seconds, thermal_state, child_state, operating_state, condition_confidence, 'OK' AS condition_quality_flags,
 coolant_temp, map, rpm, speed, intake_temp, maf, tps, ambient_temp, accel_pedal_d, accel_pedal_e, CASE WHEN p.t = gq.a THEN gap END AS segment_gap_seconds, coolant_ambient_delta, intake_ambient_delta, accel_pedal_mean, accel_pedal_channel_delta, pedal_slope, rpm_slope, engine_on_flag,
 speed_density_maf_residual, pedal_mapping_residual, coalesce(elapsed_since_start = 0, FALSE) AS engine_start_observed, cx.episode_id AS engine_start_episode_id, elapsed_since_start AS elapsed_since_engine_start, ect_start, aat_start, iat_start,
 maf_integral AS maf_integral_180s, ect_rate AS ect_rate_180s, intake_temp_stability, speed_std AS speed_std_120s, maf_std AS maf_std_120s, rpm_std AS rpm_std_120s, accel_pedal_mean_std AS accel_pedal_mean_std_120s, map_range AS map_range_60s,
 'feature_schema.v1' AS schema_version, 'calibration.v1' AS calibration_version FROM prod p JOIN cx ON cx.trip_id = p.trip_id AND cx.segment_id = p.segment_id AND cx.row_in_segment = p.row_in_segment JOIN gq ON gq.trip_id = p.trip_id AND gq.segment_id = p.segment_id)"""


def _table(spark, sf_dir, episodes=None):
    return a.production_table(samples(spark, sf_dir), episodes)


@query(with_ticks(PROD, EP, CTX, _GAPS, _TABLE) + "SELECT " + ", ".join(f"{tidy_sql(c, _ROUNDED[c])} AS {c}" if c in _ROUNDED else c for c in a.COLUMNS) + " FROM tb")
def j04_x02_production_table(spark, sf_dir):
    return _table(spark, sf_dir).withColumns({c: F.round(F.round(c, 9), n) for c, n in _ROUNDED.items()})


_BREAKS = {
    "null/trip_id": "timestamp % 211 = 0", "domain/thermal_state": "timestamp % 53 = 1", "domain/operating_state": "timestamp % 53 = 1", "null/condition_confidence": "timestamp % 101 = 2", "constant/dt_seconds": "timestamp % 67 = 3",
    "constant/calibration_version": "timestamp % 59 = 4", "type/row_in_segment": "timestamp % 73 = 5", "type/engine_on_flag": "timestamp % 79 = 6", "null/engine_start_observed": "timestamp % 83 = 7",
}


@query(
    with_ticks("tk AS (SELECT t AS timestamp FROM ticks)", "ta AS (SELECT timestamp FROM tk UNION ALL SELECT timestamp FROM tk WHERE timestamp % 97 = 8)")
    + "SELECT 'missing' AS rule, 'map_range_60s' AS \"column\", 1 AS faults UNION ALL SELECT 'unexpected', 'remark', 1 UNION ALL SELECT 'order', 'rpm', 12 UNION ALL SELECT 'type', 'speed', 1 UNION ALL "
    + " UNION ALL ".join(f"SELECT '{n.split('/')[0]}', '{n.split('/')[1]}', count(*) FROM ta WHERE {w} HAVING count(*) > 0" for n, w in _BREAKS.items())
    + " UNION ALL SELECT 'key_twice', 'trip_id,segment_id,row_in_segment', sum(n) FROM (SELECT count(*) AS n FROM ta JOIN ticks ON t = timestamp GROUP BY CASE WHEN timestamp % 211 = 0 THEN NULL ELSE trip_id END, segment_id, CASE WHEN timestamp % 73 = 5 THEN '1.5' ELSE CAST(row_in_segment AS VARCHAR) END) WHERE n > 1 HAVING count(*) > 0"
)
def v02_contract_faults(spark, sf_dir):
    """The 46-column contract over a table that has been spoilt in every way that it names."""
    df = _table(spark, sf_dir)
    df = df.select("*", F.explode(F.array_repeat(F.lit(True), F.when(F.expr("timestamp % 97 = 8"), 2).otherwise(1))).alias("_copy")).drop("_copy")  # some rows twice, in one reading
    when = lambda rule, value, otherwise: F.when(F.expr(_BREAKS[rule]), value).otherwise(otherwise)
    c = F.col
    df = df.withColumns(
        {
            "trip_id": when("null/trip_id", None, c("trip_id")), "thermal_state": when("domain/thermal_state", "lukewarm", c("thermal_state")), "operating_state": when("domain/operating_state", "lukewarm__idle", c("operating_state")),
            "condition_confidence": when("null/condition_confidence", None, c("condition_confidence")), "dt_seconds": when("constant/dt_seconds", 2.0, c("dt_seconds")), "calibration_version": when("constant/calibration_version", "calibration.v2", c("calibration_version")),
            "row_in_segment": when("type/row_in_segment", "1.5", c("row_in_segment").cast("string")), "engine_on_flag": when("type/engine_on_flag", "perhaps", c("engine_on_flag").cast("string")),
            "engine_start_observed": when("null/engine_start_observed", None, c("engine_start_observed")), "speed": c("speed").cast("int"), "remark": F.lit("x"),
        }
    )
    names = [n for n in a.COLUMNS if n != "map_range_60s"]
    at = names.index("map")
    names[at], names[at + 1] = names[at + 1], names[at]  # rpm before map
    return a.contract_faults(df.select(*names, "remark"))


_SPOILT = """ex AS (SELECT trip_id, episode_id, ect_start, aat_start, iat_start FROM ept UNION ALL SELECT trip_id, episode_id, ect_start, aat_start, iat_start FROM ept WHERE start_row % 7 = 0),
cs AS (SELECT trip_id, segment_id, row_in_segment, CASE WHEN row_in_segment % 97 = 0 THEN 'nowhere' ELSE episode_id END AS id, elapsed_since_start = 0 AND row_in_segment % 5 <> 0 AS seen, CASE WHEN row_in_segment % 31 = 0 THEN ect_start + 1 ELSE ect_start END AS ect, aat_start AS aat, iat_start AS iat FROM cx WHERE episode_id IS NOT NULL),
ee AS (SELECT trip_id, episode_id, count(*) AS n, any_value(ect_start) AS e1, any_value(aat_start) AS e2, any_value(iat_start) AS e3 FROM ex GROUP BY ALL),
jn AS (SELECT cs.*, ee.episode_id AS known, e1, e2, e3 FROM cs LEFT JOIN ee ON ee.trip_id = cs.trip_id AND ee.episode_id = cs.id)"""


@query(
    with_ticks(EP, CTX, _SPOILT)
    + """SELECT 'orphan' AS rule, count(*) AS faults FROM jn WHERE known IS NULL UNION ALL SELECT 'drifted', count(*) FROM jn WHERE known IS NOT NULL AND (ect IS DISTINCT FROM e1 OR aat IS DISTINCT FROM e2 OR iat IS DISTINCT FROM e3)
 UNION ALL SELECT 'observed_without_episode', 0 UNION ALL SELECT 'repeated', count(*) FROM ee WHERE n > 1 UNION ALL SELECT 'not_one_start', count(*) FROM ee LEFT JOIN (SELECT trip_id, id, count(*) AS c FROM cs WHERE seen GROUP BY ALL) s ON s.trip_id = ee.trip_id AND s.id = ee.episode_id WHERE coalesce(c, 0) <> 1"""
)
def v10_episode_keys(spark, sf_dir):
    """The keys of a table that has been spoilt: some episodes twice, some samples of an unknown one, some start values changed, some starts not marked."""
    episodes = written(start_episodes(ticks(spark, sf_dir)), "episodes")
    context, row = _table(spark, sf_dir, episodes).where("engine_start_episode_id is not null"), F.col("row_in_segment")
    context = context.withColumns(
        {"engine_start_episode_id": F.when(row % 97 == 0, "nowhere").otherwise(F.col("engine_start_episode_id")), "engine_start_observed": F.col("engine_start_observed") & (row % 5 != 0), "ect_start": F.when(row % 31 == 0, F.col("ect_start") + 1).otherwise(F.col("ect_start"))}
    )
    return a.episode_key_faults(context, episodes.unionByName(episodes.where("start_row % 7 = 0")))


@query(
    with_ticks(PROD)
    + """SELECT rule, rows, broken FROM (SELECT count(*) AS rows, count(*) FILTER (row_in_segment % 50 = 0) AS schema_version, 0 AS calibration_version, count(*) FILTER (row_in_segment % 40 = 0) AS dt_is_one, count(*) FILTER (row_in_segment % 30 = 0 AND thermal_state = 'post_warmup') AS state_form FROM prod)
UNPIVOT (broken FOR rule IN (schema_version, calibration_version, dt_is_one, state_form))"""
)
def v02_v15_provenance(spark, sf_dir):
    """Versions, step and state names of samples of which some are spoilt."""
    row = F.col("row_in_segment")
    df = f.production(ticks(spark, sf_dir).withColumn("operating_state", F.concat_ws("__", "thermal_state", "child_state")), **LENGTHS).select(
        F.when(row % 50 == 0, "feature_schema.v0").otherwise(a.SCHEMA_VERSION).alias("schema_version"), F.lit(a.CALIBRATION_VERSION).alias("calibration_version"), F.when(row % 40 == 0, 2.0).otherwise(1.0).alias("dt_seconds"),
        F.when(row % 30 == 0, F.regexp_replace("operating_state", "__", "_")).otherwise(F.col("operating_state")).alias("operating_state"),
    )
    return g.violations(df, a.provenance_faults(df))


@query(
    with_ticks(*SCORED, "sp AS (SELECT *, CASE WHEN window_no % 2 = 1 THEN risk_score + 0.6 ELSE risk_score END AS rs, CASE WHEN window_no % 3 = 2 THEN anomaly_type ELSE secondary_type END AS st FROM rk)")
    + """SELECT trip_id, segment_id, window_no, concat_ws(',', CASE WHEN rs > 1 THEN 'risk_score' END, CASE WHEN risk_level <> CASE WHEN rs >= 0.9 THEN 'High' WHEN rs >= 0.4129 THEN 'Medium' ELSE 'Low' END THEN 'risk_level' END,
 CASE WHEN len(keyed) = 0 THEN 'key_signals' END, CASE WHEN st = anomaly_type THEN 'secondary_type' END, CASE WHEN secondary_score > rs THEN 'secondary_order' END) AS faults FROM sp"""
)
def v17_output_contract(spark, sf_dir):
    """Risk records of which some are spoilt: scores raised without their level, the second risk of the first one's type."""
    r = risks(spark, sf_dir)
    two = F.col("secondary_risk")
    r = r.withColumns(
        {"risk_score": F.when(F.col("window_no") % 2 == 1, F.col("risk_score") + 0.6).otherwise(F.col("risk_score")), "secondary_risk": F.when(F.col("window_no") % 3 == 2, two.withField("anomaly_type", F.col("anomaly_type"))).otherwise(two)}
    )
    return r.select("trip_id", "segment_id", "window_no", F.array_join(a.output_faults(), ",").alias("faults"))


@query(
    with_ticks(*DECIDED, "rr AS (SELECT *, dtc_emitted AS e FROM rt)", "n AS (SELECT count(*) AS rows, count(*) FILTER (sub_check_id = '4-S3') AS bad, count(*) FILTER ((sub_check_id = '5-S1' AND NOT (decision_role = 'verdict' AND result_state = 'triggered')) OR (sub_check_id = '4-S3' AND e)) AS em, count(*) FILTER (sub_check_id = '5-S1' AND routed_dtc IS NULL) AS code FROM rr)")
    + "SELECT 'result_state' AS rule, rows, bad AS broken FROM n UNION ALL SELECT 'decision_role', rows, 0 FROM n UNION ALL SELECT 'emitted_is_verdict', rows, em FROM n UNION ALL SELECT 'emitted_has_code', rows, code FROM n UNION ALL SELECT 'trip', rows, 0 FROM n"
)
def v18_decision_contract(spark, sf_dir):
    """Decisions of which some are spoilt: an unknown state, codes emitted without a verdict."""
    d = all_decisions(samples(spark, sf_dir))
    sub = F.col("sub_check_id")
    d = d.withColumns({"result_state": F.when(sub == "4-S3", "unknown").otherwise(F.col("result_state")), "dtc_emitted": F.when(sub == "5-S1", True).otherwise(F.col("dtc_emitted"))})
    return g.violations(d, a.decision_faults())


@query("SELECT name, count(*) AS n FROM (SELECT lower(trim(split_part(c_name, '#', 1))) || (c_custkey % 700) AS name FROM customer) GROUP BY name HAVING count(*) > 1")
def v13_upload_names(spark, sf_dir):
    name = F.concat(F.lower(F.trim(F.split_part("c_name", F.lit("#"), F.lit(1)))), (F.col("c_custkey") % 700).cast("string"))
    return g.duplicate_keys(table(spark, sf_dir, "customer").select(name.alias("name")), ("name",))


@query("SELECT stage, n, n = (SELECT count(*) FROM orders) AS agrees FROM (SELECT 'orders' AS stage, count(DISTINCT o_orderkey) AS n FROM orders UNION ALL SELECT 'lines', count(DISTINCT l_orderkey) FROM lineitem)")
def v19_stage_identity(spark, sf_dir):
    """Whether two stages hold the same set of orders, by the order-free fingerprint of their keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    both = g.fingerprint(o, ("k",)).withColumn("stage", F.lit("orders")).unionByName(g.fingerprint(li, ("k",)).withColumn("stage", F.lit("lines")))
    first = g.fingerprint(o, ("k",)).select(*[F.col(c).alias(f"f_{c}") for c in ("rows", "sum0", "sum1", "xor0", "xor1")])
    same = (F.col("rows") == F.col("f_rows")) & (F.col("sum0") == F.col("f_sum0")) & (F.col("xor1") == F.col("f_xor1"))
    return both.crossJoin(first).select("stage", F.col("rows").alias("n"), same.alias("agrees"))  # one row each
