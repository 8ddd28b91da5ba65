"""Queries of features, rule states, episodes, events and decisions (D-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.operators import decisions as d
from roadlens.operators import features as f
from roadlens.operators import rules as r
from roadlens.operators import starts as s
from roadlens.plans.registry import query
from roadlens.plans.sql import KEYS, by, named_blocks, production_sql, runs, valid_sql, with_ticks
from roadlens.plans.starts import COLD, COLD_OPTIONS, CTX, CU, EP, S1, WARMUP, WE
from roadlens.sources.adapters import table, ticks
from roadlens.sources.scratch import written, written_by

#: The driver's tables have short blocks: windows and persistence are shortened for them; production keeps the defaults.
LENGTHS = {"span": 18, "long": 12, "short": 6}
RULES = {
    "1-S2": ((("high", "high", 3), ("critical", "high", 2)), "total_eligible", 20, "verdict", "P0217"),
    "1-S3": ((("precursor", "high", 2),), "run_meets", 6, "pending_precursor", None),
    "2-S2": ((("low", "low", 2),), "run_meets", 2, "verdict", "P0101"),
    "2-S3b": ((("zero_maf", "low", 6),), "run_meets", 6, "verdict", "P0102"),
    "3-S1a": ((("low", "low", 2), ("high", "high", 3)), "run_meets", 4, "verdict", "P2138"),
    "3-S1b": ((("extreme", "high", 2),), "run_meets", 2, "verdict", "P2138"),
    "4-S1": ((("flat", None, 5),), "run_meets_and_context", 8, "verdict", "P0111"),
    "5-S2": ((("low", "low", 1), ("high", "high", 2)), "run_meets", 1, "arbitration_evidence", None),
    "5-S3": ((("flat", None, 8),), "run_meets_and_context", 8, "verdict", "P0106"),
}
LIMITS = {"s1s3_level": 60.0, "s3s1b_delta": 3.0, "s5s2_mask": 3, "s2s2_residual": 10.0, "s5s2_rpm_slope": 2000.0}


def prod(spark, sf_dir):
    df = ticks(spark, sf_dir).withColumn("operating_state", F.concat_ws("__", "thermal_state", "child_state"))
    return f.production(df, **LENGTHS)


def samples(spark, sf_dir, rows_a_task: int = 400_000):
    """The table of ``prod``, written once and dealt out by segment, for all that is worked out from it."""
    keys, rows = ("trip_id", "segment_id"), table(spark, sf_dir, "lineitem").count()
    parts = max(spark.sparkContext.defaultParallelism, rows // rows_a_task + 1)
    df = ticks(spark, sf_dir).withColumn("operating_state", F.concat_ws("__", "thermal_state", "child_state"))
    return written_by(f.production(f.with_quality(df).repartition(parts, *keys), **LENGTHS), "samples", keys, parts)


def state(spark, sf_dir):
    return r.rule_state(prod(spark, sf_dir), LIMITS)


def trips(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("trip_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))


PROD = production_sql(**LENGTHS)
_ROUND = {"intake_temp_stability": 5, "speed_std": 5, "maf_std": 5, "rpm_std": 4, "accel_pedal_mean_std": 5}


@query(with_ticks(PROD) + f"SELECT {KEYS}, " + ", ".join(["engine_on_flag"] + [f"round({c}, {_ROUND.get(c, 6)}) AS {c}" for c in f.FEATURES[1:]]) + " FROM prod")
def d06_d08_d09_features(spark, sf_dir):
    df = prod(spark, sf_dir)
    return df.select(*f.KEYS, "engine_on_flag", *[F.round(c, _ROUND.get(c, 6)).alias(c) for c in f.FEATURES[1:]])


def _state_sql() -> str:
    m = k.LIMITS | LIMITS
    q = valid_sql
    on, post, high = "coalesce(engine_on_flag, FALSE)", "thermal_state = 'post_warmup'", "condition_confidence = 'high'"
    pedal = q("accel_pedal_d", "accel_pedal_e")
    low = f"({on} AND {pedal} AND abs(pedal_slope) <= {m['s3s1a_slope']})"
    still = f"({pedal} AND {q('rpm')} AND pedal_slope = 0 AND abs(rpm_slope) <= {m['s5s2_rpm_slope']})"
    mask = lambda name, n: f"({name} IS NOT NULL AND row_number() OVER (PARTITION BY trip_id, segment_id, block, {name} ORDER BY row_in_segment) >= {n})"
    e = {
        "1-S2": f"({on} AND {post} AND {q('coolant_temp', 'ambient_temp')} AND ambient_temp <= {m['s1s2_ambient']})",
        "1-S3": f"({post} AND {q('coolant_temp')} AND ect_rate IS NOT NULL)",
        "2-S2": f"(operating_state = 'post_warmup__high_load' AND {high} AND speed_density_maf_residual IS NOT NULL)",
        "2-S3b": q("maf", "rpm"),
        "3-S1a": "(low_motion AND pedal_mapping_residual IS NOT NULL)",
        "3-S1b": "(accel_pedal_channel_delta IS NOT NULL)",
        "4-S1": f"({on} AND {q('intake_temp', 'speed', 'maf')})",
        "5-S2": "(steady AND operating_state = 'post_warmup__steady_driving' AND speed_density_maf_residual IS NOT NULL)",
        "5-S3": f"({on} AND {q('map', 'rpm', 'speed')})",
    }
    cond = {
        ("1-S2", "high"): f"coolant_temp >= {m['s1s2_high']}", ("1-S2", "critical"): f"coolant_temp >= {m['s1s2_critical']}",
        ("1-S3", "precursor"): f"ect_rate >= {m['s1s3_rate']} AND coolant_temp >= {m['s1s3_level']}",
        ("2-S2", "low"): f"speed_density_maf_residual < {m['s2s2_residual']}", ("2-S3b", "zero_maf"): f"maf = 0 AND rpm >= {m['s2s3b_rpm']}",
        ("3-S1a", "low"): f"pedal_mapping_residual < {m['s3s1a_low']}", ("3-S1a", "high"): f"pedal_mapping_residual > {m['s3s1a_high']}",
        ("3-S1b", "extreme"): f"accel_pedal_channel_delta >= {m['s3s1b_delta']}",
        ("5-S2", "low"): f"speed_density_maf_residual < {m['s5s2_low']}", ("5-S2", "high"): f"speed_density_maf_residual > {m['s5s2_high']}",
    }
    where = lambda el, c: f"CASE WHEN coalesce({el}, FALSE) THEN coalesce({c}, FALSE) END"
    cells = [f"coalesce({v}, FALSE) AS {r.column(x, 'eligible')}" for x, v in e.items()]
    cells += [f"{where(e[x], v)} AS {r.column(x, kind)}" for (x, kind), v in cond.items()]
    sp, mf, rp, pd_ = (f"coalesce({c} >= {m[v]}, FALSE)" for c, v in (("speed_std", "speed_std"), ("maf_std", "maf_std"), ("rpm_std", "rpm_std"), ("accel_pedal_mean_std", "pedal_std")))
    cells += [
        f"coalesce({e['4-S1']}, FALSE) AND ({sp} OR {mf}) AS {r.column('4-S1', 'context')}",
        where(f"({e['4-S1']} AND intake_temp_stability IS NOT NULL)", f"intake_temp_stability <= {m['s4s1_stability']}") + f" AS {r.column('4-S1', 'flat')}",
        f"coalesce({e['5-S3']}, FALSE) AND ({rp} OR {sp} OR {pd_}) AS {r.column('5-S3', 'context')}",
        where(f"({e['5-S3']} AND map_range IS NOT NULL)", f"map_range = {m['s5s3_flat']}") + f" AS {r.column('5-S3', 'flat')}",
        where(q("intake_temp"), f"intake_temp < {m['s4s3_low']}") + " AS s4s3_below",
        where(q("intake_temp"), f"intake_temp > {m['s4s3_high']}") + " AS s4s3_above",
        f"coalesce({post} AND {high} AND {q('map', 'accel_pedal_d', 'accel_pedal_e')}, FALSE) AS s5s1_domain",
    ]
    return ",\n".join(
        [
            PROD,
            named_blocks({"block": "TRUE"}, "prod", "st"),
            runs(low, "st", "lm", "low_run"),
            f"lm2 AS (SELECT * EXCLUDE (held, starts), {mask('low_run', m['s3s1a_mask'])} AS low_motion FROM lm)",
            runs(still, "lm2", "sm", "still_run"),
            f"sm2 AS (SELECT *, {mask('still_run', m['s5s2_mask'])} AS steady FROM sm)",
            f"rs AS (SELECT {KEYS}, t, block, intake_temp, {', '.join(cells)} FROM sm2)",
        ]
    )


STATE = _state_sql()


@query(with_ticks(STATE) + "SELECT * EXCLUDE (intake_temp) FROM rs")
def d10_d20_rule_state(spark, sf_dir):
    return state(spark, sf_dir).drop("block_start", "intake_temp")


def _episodes_sql() -> str:
    parts = []
    for rule, (kinds, opportunity, *_) in RULES.items():
        specs = [("eligible", "NULL")] + [(n, str(s)) for n, _, s in kinds] + ([("context", "NULL")] if opportunity.endswith("context") else [])
        for kind, seconds in specs:
            held = f"coalesce({r.column(rule, kind)}, FALSE)" + ("" if kind in ("eligible", "context") else f" AND {r.column(rule, 'eligible')}")
            parts.append(f"SELECT {KEYS}, t, block, '{rule}' AS rule_id, '{kind}' AS kind, CAST({seconds} AS DOUBLE) AS required_s FROM rs WHERE block IS NOT NULL AND {held}")
    return (
        "lng AS (" + " UNION ALL ".join(parts) + "),\n"
        "isl AS (SELECT *, row_in_segment - row_number() OVER (PARTITION BY trip_id, segment_id, block, rule_id, kind ORDER BY row_in_segment) AS island FROM lng),\n"
        "ep AS (SELECT trip_id, segment_id, block, rule_id, kind, required_s, min(t) AS start_t, max(t) AS end_t, min(row_in_segment) AS start_row, max(row_in_segment) AS end_row,"
        " count(*) AS samples, CAST(count(*) AS DOUBLE) AS duration_s, CAST(count(*) - 1 AS DOUBLE) AS span_s, count(*) >= required_s AS meets, count(*) - required_s AS margin_s"
        " FROM isl GROUP BY trip_id, segment_id, block, rule_id, kind, required_s, island)"
    )


EPISODES = STATE + ",\n" + _episodes_sql()


@query(with_ticks(EPISODES) + "SELECT * FROM ep")
def w28_duration_episodes(spark, sf_dir):
    return r.episodes(state(spark, sf_dir), RULES)


def _decision_sql() -> str:
    """Rule by rule, kind by kind, as the rule reads: not the grouped form of the operator."""
    parts = []
    for rule, (kinds, opportunity, seconds, role, code) in RULES.items():
        chance = f"(SELECT coalesce({'sum' if opportunity == 'total_eligible' else 'max'}(duration_s), 0) >= {seconds} FROM el WHERE el.trip_id = tr.trip_id AND rule_id = '{rule}')"
        if opportunity.endswith("context"):
            chance += f" AND EXISTS (SELECT 1 FROM ep WHERE ep.trip_id = tr.trip_id AND rule_id = '{rule}' AND kind = 'context')"
        order = "CASE kind " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, *_) in enumerate(kinds)) + " END"
        dirs = "CASE kind " + " ".join(f"WHEN '{n}' THEN " + (f"'{d}'" if d else "CAST(NULL AS VARCHAR)") for n, d, _ in kinds) + " END"
        sql_code = f"'{code}'" if code else "CAST(NULL AS VARCHAR)"
        own = f"rule_id = '{rule}' AND kind NOT IN ('eligible', 'context')"
        parts.append(f"""SELECT tr.trip_id, '{rule}' AS sub_check_id, '{role}' AS decision_role, {sql_code} AS dtc_candidate, {chance} AS opp, tr.start_t AS trip_start, tr.end_t AS trip_end,
 tg.direction AS tg_direction, tg.margin AS tg_margin, tg.s AS tg_s, tg.e AS tg_e, tg.seg AS tg_seg, tg.trip_id IS NOT NULL AS fired,
 b.direction AS b_direction, b.margin AS b_margin, x.s AS x_s, x.e AS x_e, x.seg AS x_seg, coalesce(n.n, 0) AS evidence_count
 FROM tr LEFT JOIN (SELECT * FROM (SELECT trip_id, {dirs} AS direction, max(margin_s) AS margin, min(start_t) AS s, max(end_t) AS e,
   CASE WHEN count(DISTINCT segment_id) = 1 THEN min(segment_id) END AS seg, row_number() OVER (PARTITION BY trip_id ORDER BY {order}) AS o
   FROM ep WHERE {own} AND meets GROUP BY trip_id, kind) WHERE o = 1) tg ON tg.trip_id = tr.trip_id
 LEFT JOIN (SELECT * FROM (SELECT trip_id, {dirs} AS direction, max(margin_s) AS margin, row_number() OVER (PARTITION BY trip_id ORDER BY max(margin_s) DESC, {order}) AS o
   FROM ep WHERE {own} GROUP BY trip_id, kind) WHERE o = 1) b ON b.trip_id = tr.trip_id
 LEFT JOIN (SELECT trip_id, min(start_t) AS s, max(end_t) AS e, CASE WHEN count(DISTINCT segment_id) = 1 THEN min(segment_id) END AS seg FROM el WHERE rule_id = '{rule}' GROUP BY trip_id) x ON x.trip_id = tr.trip_id
 LEFT JOIN (SELECT trip_id, count(*) AS n FROM ep WHERE {own} GROUP BY trip_id) n ON n.trip_id = tr.trip_id""")
    return (
        "tr AS (SELECT trip_id, min(t) AS start_t, max(t) AS end_t FROM ticks GROUP BY trip_id),\nel AS (SELECT * FROM ep WHERE kind = 'eligible'),\n"
        "dd AS (" + " UNION ALL ".join(parts) + "),\n"
        "dec AS (SELECT trip_id, sub_check_id, CASE WHEN fired THEN tg_seg ELSE x_seg END AS segment_id,"
        " CASE WHEN fired THEN tg_s WHEN NOT opp THEN coalesce(x_s, trip_start) ELSE x_s END AS start_t, CASE WHEN fired THEN tg_e WHEN NOT opp THEN coalesce(x_e, trip_end) ELSE x_e END AS end_t,"
        " CASE WHEN fired THEN tg_direction WHEN opp THEN b_direction END AS direction, decision_role,"
        " CASE WHEN fired AND decision_role = 'pending_precursor' THEN 'pending' WHEN fired THEN 'triggered' WHEN opp THEN 'pass' ELSE 'not_evaluable' END AS result_state,"
        " CASE WHEN fired THEN 'condition_persistence_met' WHEN opp THEN 'no_trigger_with_opportunity' ELSE CASE sub_check_id WHEN '1-S2' THEN 'insufficient_evaluable_time' WHEN '1-S3' THEN 'below_minimum_evaluable_window' WHEN '3-S1a' THEN 'no_qualifying_masked_opportunity' WHEN '4-S1' THEN 'no_context_opportunity'"
        " WHEN '5-S2' THEN 'outside_steady_domain' WHEN '5-S3' THEN 'no_context_opportunity' ELSE 'no_qualifying_opportunity' END END AS decision_reason,"
        " CASE WHEN fired THEN tg_margin WHEN opp THEN b_margin END AS decision_margin, dtc_candidate, evidence_count, opp AS opportunity_present FROM dd)"
    )


DECISIONS = EPISODES + ",\n" + _decision_sql()


def decisions(spark, sf_dir):
    return r.duration_decisions(r.episodes(state(spark, sf_dir), RULES), trips(spark, sf_dir), RULES)


@query(with_ticks(DECISIONS) + "SELECT * FROM dec")
def d24_duration_decision(spark, sf_dir):
    return decisions(spark, sf_dir)


RANGE = """rd AS (SELECT trip_id, '4-S3' AS sub_check_id, CASE WHEN told > 0 AND g1 = g2 THEN g1 END AS segment_id, a AS start_t, z AS end_t, direction, 'verdict' AS decision_role, CASE WHEN hit > 0 THEN 'triggered' WHEN told > 0 THEN 'pass' ELSE 'not_evaluable' END AS result_state,
 CASE WHEN hit > 0 THEN 'range_violation' WHEN told > 0 THEN 'no_trigger_with_opportunity' ELSE 'signal_unavailable' END AS decision_reason, decision_margin, CASE direction WHEN 'low' THEN 'P0112' WHEN 'high' THEN 'P0113' END AS dtc_candidate, CASE WHEN hit > 0 THEN hit ELSE told END AS evidence_count, told > 0 AS opportunity_present
 FROM (SELECT trip_id, count(*) FILTER (s4s3_below OR s4s3_above) AS hit, count(s4s3_below) AS told, CASE WHEN count(*) FILTER (s4s3_below) > 0 THEN 'low' WHEN count(*) FILTER (s4s3_above) > 0 THEN 'high' END AS direction,
  coalesce(max(-40.0 - intake_temp) FILTER (s4s3_below), max(intake_temp - 215.0) FILTER (s4s3_above)) AS decision_margin,
  min(t) FILTER (w) AS a, max(t) FILTER (w) AS z, min(segment_id) FILTER (w) AS g1, max(segment_id) FILTER (w) AS g2 FROM (SELECT *, CASE WHEN bool_or(coalesce(s4s3_below OR s4s3_above, FALSE)) OVER p THEN coalesce(s4s3_below OR s4s3_above, FALSE) WHEN count(s4s3_below) OVER p > 0 THEN s4s3_below IS NOT NULL ELSE TRUE END AS w FROM rs WINDOW p AS (PARTITION BY trip_id)) GROUP BY trip_id))"""


@query(with_ticks(STATE, RANGE) + "SELECT * FROM rd")
def d25_range_decision(spark, sf_dir):
    return r.range_decisions(state(spark, sf_dir), LIMITS)


#: Splits of magnitude are not published; these divide the driver's steps.
SPLITS = {"idle": 20.0, "steady_driving": 20.0, "acceleration": 25.0, "high_load": 30.0}
EVENTS = f"""{named_blocks({"block": "TRUE"}, "prod", "sb")},
pv AS (SELECT *, {valid_sql("map", "accel_pedal_d", "accel_pedal_e")} AS sound,
 CASE operating_state WHEN 'post_warmup__idle' THEN 9.2 WHEN 'post_warmup__steady_driving' THEN 11.4 WHEN 'post_warmup__acceleration' THEN 18.6 WHEN 'post_warmup__high_load' THEN 26.5 END AS step,
 CASE operating_state WHEN 'post_warmup__idle' THEN 20.0 WHEN 'post_warmup__steady_driving' THEN 20.0 WHEN 'post_warmup__acceleration' THEN 25.0 WHEN 'post_warmup__high_load' THEN 30.0 END AS spl FROM sb),
lk AS (SELECT *, lag(t) OVER {by("block")} IS NOT NULL AND lead(t, 2) OVER {by("block")} IS NOT NULL AS inside, coalesce(lag(sound) OVER {by("block")} AND lead(sound) OVER {by("block")} AND lead(sound, 2) OVER {by("block")}, FALSE) AS around,
 lag(map) OVER {by("block")} AS base, lead(map) OVER {by("block")} AS p1, lead(map, 2) OVER {by("block")} AS p2 FROM pv),
ev AS (SELECT *, inside AND around AS complete, greatest(abs(map - base), abs(p1 - base), abs(p2 - base)) AS response, CASE WHEN pedal_slope >= spl THEN 'hi' ELSE 'lo' END AS bin FROM lk
 WHERE thermal_state = 'post_warmup' AND condition_confidence = 'high' AND sound AND pedal_slope >= step),
el0 AS (SELECT *, CASE WHEN bin = 'hi' THEN CASE child_state WHEN 'idle' THEN 4.0 WHEN 'steady_driving' THEN 3.0 WHEN 'acceleration' THEN 9.0 ELSE 1.0 END ELSE CASE child_state WHEN 'idle' THEN 8.0 WHEN 'acceleration' THEN 4.0 WHEN 'high_load' THEN 13.4 END END AS lim FROM ev),
er AS (SELECT *, CASE WHEN NOT complete THEN NULL WHEN lim IS NULL THEN 'not_evaluable' WHEN response < lim THEN 'no_response' ELSE 'response' END AS event_result FROM el0),
ew AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY t, segment_id, row_in_segment) AS event_index, row_number() OVER d AS o, count(*) OVER l AS n, sum(CASE WHEN event_result = 'no_response' THEN 1 ELSE 0 END) OVER l AS miss FROM er
 WINDOW d AS (PARTITION BY trip_id, complete ORDER BY t, segment_id, row_in_segment), l AS (PARTITION BY trip_id, complete ORDER BY t, segment_id, row_in_segment ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
pe AS (SELECT {KEYS}, t, block AS continuity_block_id, operating_state, pedal_slope, CAST(step AS DOUBLE) AS pedal_step_threshold, bin AS magnitude_bin, CAST(spl AS DOUBLE) AS magnitude_split_threshold, complete AS window_complete,
 CASE WHEN NOT inside THEN 'neighborhood_outside_block' WHEN NOT around THEN 'neighborhood_quality' END AS window_incomplete_reason, CASE WHEN complete THEN base END AS baseline_map, CASE WHEN complete THEN response END AS response_kpa,
 CAST(lim AS DOUBLE) AS no_response_threshold_kpa, complete AND lim IS NOT NULL AS evaluable, event_result, CAST(event_index AS INTEGER) AS event_index_in_trip, CASE WHEN complete THEN CAST(o AS INTEGER) END AS complete_event_ordinal,
 CASE WHEN complete THEN CAST(n AS INTEGER) END AS recent_window_size, CASE WHEN complete THEN CAST(miss AS INTEGER) END AS no_response_count_recent_n, CASE WHEN complete THEN miss >= 3 END AS m_of_n_triggered, CASE WHEN complete THEN CAST(miss - 3 AS INTEGER) END AS decision_margin FROM ew)"""


@query(with_ticks(PROD, EVENTS) + "SELECT * EXCLUDE (pedal_slope), round(pedal_slope, 6) AS pedal_slope FROM pe")
def d23_pedal_events(spark, sf_dir):
    return r.pedal_events(prod(spark, sf_dir), split=SPLITS).withColumn("pedal_slope", F.round("pedal_slope", 6))


STEP = """sd AS (SELECT trip_id, '5-S1' AS sub_check_id, CASE WHEN n > 0 AND g1 = g2 THEN g1 END AS segment_id, CASE WHEN n > 0 THEN a ELSE start_t END AS start_t, CASE WHEN n > 0 THEN z ELSE end_t END AS end_t, CAST(NULL AS VARCHAR) AS direction, 'verdict' AS decision_role,
 CASE WHEN n = 0 THEN 'not_evaluable' WHEN fired THEN 'triggered' ELSE 'pass' END AS result_state, CASE WHEN n = 0 THEN 'no_valid_events' WHEN fired THEN 'm_of_n_met' ELSE 'no_trigger_with_opportunity' END AS decision_reason,
 CASE WHEN n > 0 THEN CAST(most - 3 AS DOUBLE) END AS decision_margin, 'P0106' AS dtc_candidate, n AS evidence_count, n > 0 AS opportunity_present
 FROM (SELECT tr.trip_id, any_value(tr.start_t) AS start_t, any_value(tr.end_t) AS end_t, count(*) FILTER (evaluable) AS n, coalesce(bool_or(m_of_n_triggered), FALSE) AS fired, coalesce(max(no_response_count_recent_n), 0) AS most,
  min(pe.t) FILTER (evaluable) AS a, max(pe.t) FILTER (evaluable) AS z, min(segment_id) FILTER (evaluable) AS g1, max(segment_id) FILTER (evaluable) AS g2 FROM tr LEFT JOIN pe ON pe.trip_id = tr.trip_id GROUP BY tr.trip_id))"""


@query(with_ticks(PROD, EVENTS, "tr AS (SELECT trip_id, min(t) AS start_t, max(t) AS end_t FROM ticks GROUP BY trip_id)", STEP) + "SELECT * FROM sd")
def d26_step_decision(spark, sf_dir):
    return r.step_decisions(r.pedal_events(prod(spark, sf_dir), split=SPLITS), trips(spark, sf_dir))


_FACE = "sub_check_id, {scope} AS unit_scope, trip_id, segment_id, {episode} AS engine_start_episode_id, start_t AS evidence_start_timestamp, end_t AS evidence_end_timestamp, direction, decision_role, result_state, decision_reason, decision_margin, dtc_candidate AS dtc_candidate_label, evidence_count, opportunity_present"
_of = lambda scope, episode="CAST(NULL AS VARCHAR)": _FACE.format(scope=f"'{scope}'", episode=episode)
ALL = f"""alld AS (SELECT {_of("trip")} FROM dec UNION ALL SELECT {_of("trip")} FROM rd UNION ALL SELECT {_of("trip")} FROM sd UNION ALL SELECT {_of("engine_start_episode", "episode_id")} FROM s1d UNION ALL SELECT {_of("segment_first_row")} FROM cd)"""
ROUTE = """wit AS (SELECT trip_id, bool_or(sub_check_id IN ('5-S3', '5-S1') AND result_state = 'triggered') AS abnormal, count(DISTINCT sub_check_id) FILTER (sub_check_id IN ('5-S3', '5-S1') AND result_state IN ('pass', 'triggered')) = 2 AS normal FROM alld GROUP BY trip_id),
cpt AS (SELECT DISTINCT trip_id, TRUE AS cap FROM cs WHERE cap_start_row IS NOT NULL),
ra AS (SELECT alld.*, coalesce(cap, FALSE) AS cap, CASE WHEN result_state <> 'triggered' THEN NULL WHEN sub_check_id = '2-S3b' THEN 'direct' WHEN sub_check_id IN ('2-S2', '5-S2') THEN CASE WHEN abnormal THEN 'map_sensor' WHEN normal THEN 'maf_sensor' ELSE 'unisolated' END END AS routing_attribution FROM alld JOIN wit USING (trip_id) LEFT JOIN cpt USING (trip_id)),
rt AS (SELECT CASE substr(sub_check_id, 1, 1) WHEN '1' THEN 'cooling_degradation' WHEN '2' THEN 'air_intake_maf_anomaly' WHEN '3' THEN 'accelerator_pedal_sensor' WHEN '4' THEN 'intake_air_temperature_sensor_fault' ELSE 'map_load_signal_plausibility_fault' END AS proxy_id, * EXCLUDE (cap),
 CASE routing_attribution WHEN 'direct' THEN 'P0102' WHEN 'map_sensor' THEN 'P0106' WHEN 'maf_sensor' THEN 'P0101' WHEN 'unisolated' THEN 'P006A' ELSE CASE WHEN result_state = 'triggered' AND decision_role = 'verdict' THEN dtc_candidate_label END END AS routed_dtc,
 result_state = 'triggered' AND (decision_role = 'verdict' OR sub_check_id IN ('2-S2', '2-S3b')) AS dtc_emitted, CASE WHEN cap AND routing_attribution IS NOT NULL AND sub_check_id <> '2-S3b' THEN 'low' WHEN decision_role = 'support' THEN 'low' WHEN sub_check_id = '3-S1b' THEN 'provisional' ELSE 'high' END AS confidence,
 cap AND routing_attribution IS NOT NULL AND sub_check_id <> '2-S3b' AS confidence_capped_low FROM ra)"""
#: All CTEs of the routed decision table; ``rt`` is the last.
DECIDED = (DECISIONS, RANGE, EVENTS, STEP, EP, CTX, COLD, CU, WE, S1, ALL, ROUTE)


def all_decisions(samples):
    """The routed decision table of every scope, from the written table of samples with features: the rule state, episodes and first rows are worked out once."""
    st = written(r.rule_state(samples, LIMITS), "rule-state")
    whole = samples.groupBy("trip_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))
    signals = ("rpm", "coolant_temp", "ambient_temp", "intake_temp")
    few = samples.select("trip_id", "segment_id", "row_in_segment", "t", *signals, *[f"{s}_ok" for s in signals], "maf_integral")
    episodes, cold = written(s.start_episodes(few), "episodes"), written(s.cold_start(few, **COLD_OPTIONS), "first-rows")
    evidence = s.warmup_evidence(few, s.with_start_context(few, episodes), episodes, cold, **WARMUP)
    trip = [r.duration_decisions(r.episodes(st, RULES), whole, RULES), r.range_decisions(st, LIMITS), r.step_decisions(r.pedal_events(samples, split=SPLITS), whole)]
    return d.decision_table(trip, s.start_decisions(evidence), s.cold_decisions(cold), cold.where("cap_start_row is not null"))


_TIDY = "* EXCLUDE (decision_margin), round(decision_margin, 5) AS decision_margin"


@query(with_ticks(*DECIDED) + f"SELECT {_TIDY} FROM rt")
def d29_d30_routed_decisions(spark, sf_dir):
    """All 21 columns of the decisions of trips, engine starts and segments' first rows."""
    return all_decisions(samples(spark, sf_dir)).withColumn("decision_margin", F.round("decision_margin", 5))


@query(with_ticks(PROD, EP, CTX, COLD, WE, S1) + "SELECT * FROM s1d")
def d22_d27_start_decision(spark, sf_dir):
    df = samples(spark, sf_dir)
    episodes = written(s.start_episodes(df), "episodes")
    return s.start_decisions(s.warmup_evidence(df, s.with_start_context(df, episodes), episodes, s.cold_start(df, **COLD_OPTIONS), **WARMUP))


@query(with_ticks(*DECIDED) + "SELECT sub_check_id, result_state, count(*) AS n FROM rt GROUP BY ALL")
def a24_decision_states(spark, sf_dir):
    return all_decisions(samples(spark, sf_dir)).groupBy("sub_check_id", "result_state").agg(F.count("*").alias("n"))
