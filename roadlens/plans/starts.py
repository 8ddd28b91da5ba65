"""Queries of engine starts (W-16, W-17, W-34, J-03, J-08, D-07, D-21, D-22, D-27, D-28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import starts as st
from roadlens.plans.registry import query
from roadlens.plans.sql import BLK, KEYS, SEG, blocks, named_blocks, runs, valid_sql, with_ticks
from roadlens.sources.adapters import ticks

EP = ",\n".join(
    [
        blocks("rpm"),
        runs("rpm >= 50"),
        f"ed AS (SELECT *, held AND lag(held) OVER ({BLK}) = FALSE AS edge, lead(ok) OVER ({SEG}) AS n_ok, lead(block) OVER ({SEG}) AS n_block FROM run_t)",
        "sg AS (SELECT trip_id, segment_id, min(t) AS start, bool_and(ok) FILTER (row_in_segment = 1) AS first_ok FROM ed GROUP BY ALL)",
        "sn AS (SELECT *, lead(first_ok) OVER (ORDER BY start, trip_id, segment_id) AS after FROM sg)",
        "rn AS (SELECT trip_id, segment_id, block, run, min(t) AS start_t, max(t) AS end_t, min(row_in_segment) AS start_row, max(row_in_segment) AS end_row, count(*) AS samples FROM ed WHERE run IS NOT NULL GROUP BY ALL HAVING bool_or(edge))",
        f"""es0 AS (SELECT rn.*, l.n_ok, l.n_block, after, CASE WHEN {valid_sql('coolant_temp')} THEN s.coolant_temp END AS ect_start, CASE WHEN {valid_sql('ambient_temp')} THEN s.ambient_temp END AS aat_start,
 CASE WHEN {valid_sql('intake_temp')} THEN s.intake_temp END AS iat_start, row_number() OVER (PARTITION BY rn.trip_id ORDER BY start_t, rn.segment_id) AS no
 FROM rn JOIN ed l ON l.trip_id = rn.trip_id AND l.segment_id = rn.segment_id AND l.row_in_segment = rn.end_row JOIN ticks s ON s.trip_id = rn.trip_id AND s.segment_id = rn.segment_id AND s.row_in_segment = rn.start_row
 JOIN sn ON sn.trip_id = rn.trip_id AND sn.segment_id = rn.segment_id)""".replace("coolant_temp_", "s.coolant_temp_").replace("ambient_temp_", "s.ambient_temp_").replace("intake_temp_", "s.intake_temp_")
        .replace("(coolant_temp IS", "(s.coolant_temp IS").replace("(ambient_temp IS", "(s.ambient_temp IS").replace("(intake_temp IS", "(s.intake_temp IS"),
        """ept AS (SELECT trip_id, printf('%s_start_%03d', trip_id, no) AS episode_id, segment_id, start_t, end_t, start_row, end_row, samples,
 CASE WHEN n_ok = FALSE THEN 'rpm_invalid' WHEN n_ok AND n_block <> block THEN 'continuity_break' WHEN n_ok THEN 'rpm_below_50' WHEN after IS NULL THEN 'end_of_data' WHEN NOT after THEN 'rpm_invalid' ELSE 'continuity_break' END AS termination_reason,
 ect_start, aat_start, iat_start FROM es0)""",
    ]
)
CTX = f"""cx AS (SELECT {", ".join("k." + x for x in KEYS.split(", "))}, e.episode_id, CAST(k.t - e.start_t AS DOUBLE) AS elapsed_since_start, e.ect_start, e.aat_start, e.iat_start FROM ticks k
 LEFT JOIN ept e ON e.trip_id = k.trip_id AND e.segment_id = k.segment_id AND k.row_in_segment BETWEEN e.start_row AND e.end_row)"""


@query(with_ticks(EP) + "SELECT * FROM ept")
def d07_w17_start_episodes(spark, sf_dir):
    return st.start_episodes(ticks(spark, sf_dir))


def _context(spark, sf_dir):
    df = ticks(spark, sf_dir)
    return st.with_start_context(df, st.start_episodes(df))


@query(with_ticks(EP, CTX) + "SELECT * FROM cx")
def d07_j03_start_context(spark, sf_dir):
    return _context(spark, sf_dir)


#: The driver's engines run for some sixty rows: a target of 35 degrees, quick bands, and a soak of a minute; coolant is no witness.
WARMUP = {"rates": {"low": (180.0, 140.0, 100.0, 80.0), "high": (60.0, 50.0, 40.0, 30.0)}, "target": 35.0, "split": 20.0, "heat": 450.0}
COLD_OPTIONS = {"gap_s": 60.0, "ect_witness": 100.0}

COLD = f"""sgp AS (SELECT trip_id, segment_id, min(t) AS a, max(t) AS z FROM ticks GROUP BY ALL),
gp AS (SELECT trip_id, segment_id, CASE WHEN a - lag(z) OVER (ORDER BY a, trip_id, segment_id) >= 0 THEN CAST(a - lag(z) OVER (ORDER BY a, trip_id, segment_id) AS DOUBLE) END AS gap_seconds FROM sgp),
{named_blocks({"block": valid_sql("rpm")}, "ticks", "cb")},
ce AS (SELECT *, block = 1 AND rpm >= 50 AND lag(rpm) OVER ({BLK}) < 50 AS edge, {valid_sql("rpm")} AS rpm_ok, {valid_sql('coolant_temp', 'ambient_temp', 'intake_temp')} AS okk FROM cb),
cq AS (SELECT trip_id, segment_id, min(row_in_segment) FILTER (edge) AS q, arg_min(t, row_in_segment) FILTER (edge) AS qt, max(row_in_segment) FILTER (block = 1) AS z, arg_max(t, row_in_segment) FILTER (block = 1) AS zt FROM ce GROUP BY ALL),
cr AS (SELECT ce.*, gap_seconds, CASE WHEN block = 1 THEN q END AS q, qt, z, zt, abs(coolant_temp - ambient_temp) AS ect, abs(intake_temp - ambient_temp) AS iat FROM ce JOIN gp USING (trip_id, segment_id) JOIN cq USING (trip_id, segment_id) WHERE row_in_segment = 1),
cv0 AS (SELECT *, CASE WHEN gap_seconds IS NULL OR gap_seconds < 60 THEN 'cold_soak_gap_unavailable' WHEN NOT (rpm_ok AND rpm < 50) THEN 'first_row_engine_on' WHEN q IS NULL THEN 'no_observed_start_in_block' WHEN NOT okk THEN 'signal_quality' END AS barred FROM cr),
cs AS (SELECT trip_id, segment_id, t AS first_t, gap_seconds, q AS qualifying_start, ect AS ect_delta, iat AS iat_delta, coalesce(barred, CASE WHEN iat > 7 THEN 'iat_witness_failed' END) AS reason,
 barred IS NULL AND iat <= 7 AS s1s4_eligible, CASE WHEN barred IS NULL AND iat <= 7 THEN ect > 15 END AS s1s4_exceed, barred IS NULL AND ect <= 100 AS s4s2_eligible, CASE WHEN barred IS NULL AND ect <= 100 THEN iat > 7 END AS s4s2_exceed,
 CASE WHEN barred IS NULL AND ect <= 100 AND iat > 7 THEN q END AS cap_start_row, CASE WHEN barred IS NULL AND ect <= 100 AND iat > 7 THEN qt END AS cap_start_t, CASE WHEN barred IS NULL AND ect <= 100 AND iat > 7 THEN z END AS cap_end_row, CASE WHEN barred IS NULL AND ect <= 100 AND iat > 7 THEN zt END AS cap_end_t FROM cv0)"""
_TIDY = "first_t, gap_seconds, qualifying_start, round(ect_delta, 6) AS ect_delta, round(iat_delta, 6) AS iat_delta, reason, s1s4_eligible, s1s4_exceed, s4s2_eligible, s4s2_exceed"


def _cold(spark, sf_dir):
    return st.cold_start(ticks(spark, sf_dir), **COLD_OPTIONS)


@query(with_ticks(COLD) + f"SELECT trip_id, segment_id, {_TIDY} FROM cs")
def d21_j08_cold_start(spark, sf_dir):
    out = _cold(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("ect_delta", "iat_delta")})
    return out.drop("cap_start_row", "cap_start_t", "cap_end_row", "cap_end_t")


@query(with_ticks(COLD) + "SELECT c.trip_id, c.segment_id, cap_start_row, cap_end_row, cap_start_t, cap_end_t, count(*) AS samples FROM cs c JOIN ticks k ON k.trip_id = c.trip_id AND k.segment_id = c.segment_id AND k.row_in_segment BETWEEN cap_start_row AND cap_end_row GROUP BY ALL")
def w34_j11_cap_interval(spark, sf_dir):
    """From the start that ends a cold soak to the end of its block, where the intake was warm; what it covers is counted in the samples."""
    caps = _cold(spark, sf_dir).where("cap_start_row is not null").select("trip_id", "segment_id", "cap_start_row", "cap_end_row", "cap_start_t", "cap_end_t")
    inside = F.col("row_in_segment").between(F.col("cap_start_row"), F.col("cap_end_row"))  # a row a segment at most
    return ticks(spark, sf_dir).select("trip_id", "segment_id", "row_in_segment").join(caps, ["trip_id", "segment_id"]).where(inside).groupBy(*caps.columns).agg(F.count("*").alias("samples"))


CU = """cu AS (SELECT trip_id, segment_id, first_t, reason, '1-S4' AS sub_check_id, s1s4_eligible AS told, s1s4_exceed AS c, ect_delta - 15 AS m, 'P0116' AS code FROM cs UNION ALL SELECT trip_id, segment_id, first_t, reason, '4-S2', s4s2_eligible, s4s2_exceed, iat_delta - 7, 'P0111' FROM cs),
cd AS (SELECT trip_id, sub_check_id, segment_id, first_t AS start_t, first_t AS end_t, CAST(NULL AS VARCHAR) AS direction, 'support' AS decision_role, CASE WHEN c THEN 'triggered' WHEN told THEN 'pass' ELSE 'not_evaluable' END AS result_state,
 CASE WHEN c THEN 'cold_start_delta_exceeded' WHEN told THEN 'cold_start_delta_within_bound' ELSE coalesce(reason, 'witness_or_quality_failed') END AS decision_reason, CASE WHEN told THEN m END AS decision_margin, code AS dtc_candidate, CAST(1 AS BIGINT) AS evidence_count, told AS opportunity_present FROM cu)"""


@query(with_ticks(COLD, CU) + "SELECT * EXCLUDE (decision_margin), round(decision_margin, 6) AS decision_margin FROM cd")
def d28_cold_decision(spark, sf_dir):
    return st.cold_decisions(_cold(spark, sf_dir)).withColumn("decision_margin", F.round("decision_margin", 6))


_BUD = lambda a, b, c, d: f"(greatest(0, 30 - greatest(ect_start, -273)) / {a} + greatest(0, 35 - greatest(ect_start, 30)) / {b} + greatest(0, 35 - greatest(ect_start, 50)) / {c} + greatest(0, 35 - greatest(ect_start, 65)) / {d}) * 60 * 1.3"
#: On ``prod``: evidence of engine starts.
WE = f"""w0 AS (SELECT *, CAST(end_t - start_t AS DOUBLE) AS observed_s, coalesce(ect_start <= 50 AND ect_start < 35 AND aat_start >= -7, FALSE) AS guards FROM ept),
w1 AS (SELECT *, CASE WHEN guards THEN CASE WHEN aat_start <= 20 THEN 'low' ELSE 'high' END END AS ambient_bin, CASE WHEN guards THEN round(CASE WHEN aat_start <= 20 THEN {_BUD(180, 140, 100, 80)} ELSE {_BUD(60, 50, 40, 30)} END, 6) END AS budget_s FROM w0),
wj AS (SELECT w1.trip_id, w1.episode_id, elapsed_since_start AS el, budget_s, maf_integral, CASE WHEN coalesce({valid_sql('coolant_temp')}, FALSE) AND coolant_temp >= 35 THEN elapsed_since_start END AS hit
 FROM cx JOIN prod USING (trip_id, segment_id, row_in_segment) JOIN w1 ON w1.trip_id = cx.trip_id AND w1.episode_id = cx.episode_id),
wa AS (SELECT trip_id, episode_id, min(hit) AS reached_s, min(CASE WHEN el >= budget_s THEN el END) AS el0 FROM wj GROUP BY ALL),
wh AS (SELECT wa.*, maf_integral AS heat FROM wa LEFT JOIN wj ON wj.trip_id = wa.trip_id AND wj.episode_id = wa.episode_id AND wj.el = wa.el0),
we AS (SELECT w1.*, coalesce(budget_s <= 1800, FALSE) AS live, reached_s, heat, coalesce(cs.qualifying_start IS NOT NULL AND s1s4_eligible, FALSE) AS sup, s1s4_exceed AS sup_over, CASE WHEN cs.qualifying_start IS NULL THEN 'cold_soak_unavailable' ELSE coalesce(reason, 'cold_soak_unavailable') END AS sup_reason
 FROM w1 LEFT JOIN wh USING (trip_id, episode_id) LEFT JOIN cs ON cs.trip_id = w1.trip_id AND cs.segment_id = w1.segment_id AND cs.qualifying_start = w1.start_row)"""
S1 = """s1 AS (SELECT *, coalesce(sup AND sup_over, FALSE) AS over, sup AND NOT coalesce(sup_over, FALSE) AS passes, NOT sup AND sup_reason IN ('cold_soak_gap_unavailable', 'first_row_engine_on', 'no_observed_start_in_block') AS soak_only FROM we),
s1w AS (SELECT *, CASE WHEN NOT guards THEN 'start_guards_failed' WHEN NOT live THEN 'budget_out_of_domain' WHEN over THEN 'support_triggered_sensor_untrusted' WHEN coalesce(reached_s <= budget_s, FALSE) THEN CASE WHEN passes THEN 'target_reached_within_budget' WHEN soak_only THEN 'support_cold_soak_unavailable_pass_forbidden' ELSE 'support_not_evaluable' END
 WHEN reached_s IS NULL AND observed_s < budget_s THEN 'right_censored' WHEN NOT coalesce(heat > 450, FALSE) THEN 'insufficient_heat_input' WHEN passes OR soak_only THEN 'budget_expired_below_target' ELSE 'support_not_evaluable' END AS why FROM s1),
s1d AS (SELECT trip_id, episode_id, '1-S1' AS sub_check_id, segment_id, start_t, end_t, 'low' AS direction, 'verdict' AS decision_role, CASE why WHEN 'target_reached_within_budget' THEN 'pass' WHEN 'budget_expired_below_target' THEN 'triggered' ELSE 'not_evaluable' END AS result_state, why AS decision_reason,
 round(CASE why WHEN 'target_reached_within_budget' THEN budget_s - reached_s WHEN 'budget_expired_below_target' THEN reached_s - budget_s END, 6) AS decision_margin, 'P0128' AS dtc_candidate, CAST(1 AS BIGINT) AS evidence_count, why IN ('target_reached_within_budget', 'budget_expired_below_target') AS opportunity_present FROM s1w)"""
