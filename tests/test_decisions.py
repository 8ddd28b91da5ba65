"""Step events, engine-start decisions, routing and the cap, at their boundaries."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from roadlens.operators import decisions as d
from roadlens.operators import records, rules, starts

STATE = "post_warmup__acceleration"


def samples(spark, rows):
    """(segment, row, slope, map, changes) as samples of ``with_quality``."""
    made = []
    for segment, row, slope, press, change in rows:
        one = dict(trip_id="t", segment_id=segment, row_in_segment=row, t=1000 * int(segment[1:]) + row, pedal_slope=slope, map=press, thermal_state="post_warmup", condition_confidence="high", operating_state=STATE)
        made.append(Row(**(one | {f"{x}_ok": True for x in ("map", "accel_pedal_d", "accel_pedal_e")} | change)))
    return spark.createDataFrame(made, "trip_id string, segment_id string, row_in_segment int, t long, pedal_slope double, map double, thermal_state string, condition_confidence string, operating_state string, map_ok boolean, accel_pedal_d_ok boolean, accel_pedal_e_ok boolean")


def events(spark, rows, **options):
    return {(r["segment_id"], r["row_in_segment"]): r for r in rules.pedal_events(samples(spark, rows), **options).collect()}


def test_only_upward_steps_of_the_domain_are_events(spark):
    slopes = {2: 18.6, 6: -40.0, 10: 18.5, 14: 30.0, 18: 30.0, 22: 30.0}
    change = {14: {"thermal_state": "warmup"}, 18: {"condition_confidence": "medium"}, 22: {"accel_pedal_e_ok": False}}
    rows = [("s1", i, slopes.get(i, 0.0), 100.0, change.get(i, {})) for i in range(1, 30)]
    assert sorted(r for _, r in events(spark, rows)) == [2]


def test_windows_limits_and_slots(spark):
    slopes = {1: 20.0, 5: 20.0, 10: 20.0, 15: 20.0, 20: 40.0, 25: 20.0, 30: 20.0}
    press = {16: 104.0, 12: 103.9, 21: 120.0}  # at the limit of 4 there is a response, just below there is none
    change = {7: {"map_ok": False}, 20: {"operating_state": "post_warmup__steady_driving"}}
    rows = [("s1", i, slopes.get(i, 0.0), press.get(i, 100.0), change.get(i, {})) for i in range(1, 31)]
    e = {row: r for (_, row), r in events(spark, rows, split={"steady_driving": 50.0}).items()}
    assert {r: x["window_incomplete_reason"] for r, x in e.items() if not x["window_complete"]} == {1: "neighborhood_outside_block", 5: "neighborhood_quality", 30: "neighborhood_outside_block"}
    assert {r: x["event_result"] for r, x in e.items()} == {1: None, 5: None, 10: "no_response", 15: "response", 20: "not_evaluable", 25: "no_response", 30: None}
    assert [e[r]["no_response_count_recent_n"] for r in (10, 15, 20, 25)] == [1, 1, 1, 2] and [e[r]["recent_window_size"] for r in (10, 15, 20, 25)] == [1, 2, 3, 4]
    assert e[25]["decision_margin"] == -1 and e[25]["m_of_n_triggered"] is False and e[1]["m_of_n_triggered"] is None and e[15]["response_kpa"] == 4.0
    assert e[20]["magnitude_bin"] == "lo" and e[20]["event_index_in_trip"] == 5 and e[20]["complete_event_ordinal"] == 3


def test_three_misses_trigger_before_there_are_four(spark):
    rows = [("s1", i, 20.0 if i in (5, 10, 15) else 0.0, 100.0, {}) for i in range(1, 20)] + [("s2", 1, 0.0, 100.0, {})]
    df = samples(spark, rows)
    trips = spark.createDataFrame([("t", 0, 9), ("none", 3, 7)], "trip_id string, start_t long, end_t long")
    got = {r["trip_id"]: r for r in rules.step_decisions(rules.pedal_events(df), trips).collect()}
    assert (got["t"]["result_state"], got["t"]["decision_margin"], got["t"]["evidence_count"], got["t"]["segment_id"], got["t"]["start_t"]) == ("triggered", 0.0, 3, "s1", 1005)
    assert (got["none"]["result_state"], got["none"]["decision_reason"], got["none"]["start_t"], got["none"]["decision_margin"]) == ("not_evaluable", "no_valid_events", 3, None)
    one = rules.step_decisions(rules.pedal_events(df.where("row_in_segment < 9")), trips).where("trip_id = 't'").first()
    assert (one["result_state"], one["decision_margin"]) == ("pass", -2.0)  # one evaluable event is an opportunity


def test_first_steps_need_four_in_a_segment(spark):
    rows = [("s1", i, 20.0 if i in (1, 2, 9, 20, 25) else 0.0, 100.0, {}) for i in range(1, 26)] + [("s2", i, 20.0 if i < 4 else 0.0, 100.0, {}) for i in range(1, 9)]
    got = records.first_steps(samples(spark, rows)).orderBy("row_in_segment").collect()
    assert [(r["segment_id"], r["row_in_segment"], r["k"]) for r in got] == [("s1", 1, 1), ("s1", 2, 2), ("s1", 9, 3), ("s1", 20, 4)]
    assert {(r["start_t"], r["end_t"]) for r in got} == {(1001, 1022)}
    small = [(s, i, x, p, c | {"operating_state": "post_warmup__steady_driving"}) for s, i, x, p, c in rows]
    assert records.first_steps(samples(spark, small), split={"steady_driving": 21.0}).count() == 0


def table(spark, rows):
    schema = "trip_id string, sub_check_id string, segment_id string, start_t long, end_t long, direction string, decision_role string, result_state string, decision_reason string, decision_margin double, dtc_candidate string, evidence_count long, opportunity_present boolean"
    return d.of_scope(spark.createDataFrame([(t, sub, None, 1, 2, None, role, state, "r", None, code, 1, True) for t, sub, state, role, code in rows], schema), "trip")


def test_routing_asks_for_all_witnesses(spark):
    cases = {
        "both": ("pass", "pass", "maf_sensor", "P0101"), "flat": ("triggered", "pass", "map_sensor", "P0106"), "step": ("not_evaluable", "triggered", "map_sensor", "P0106"),
        "half": ("pass", "not_evaluable", "unisolated", "P006A"), "other": ("not_evaluable", "pass", "unisolated", "P006A"), "none": ("not_evaluable", "not_evaluable", "unisolated", "P006A"), "missing": ("pass", None, "unisolated", "P006A"),
    }
    rows = []
    for trip, (flat, step, *_ ) in cases.items():
        rows += [(trip, "2-S2", "triggered", "verdict", "P0101"), (trip, "5-S2", "triggered", "arbitration_evidence", None), (trip, "2-S3b", "triggered", "verdict", "P0102"), (trip, "5-S3", flat, "verdict", "P0106")]
        rows += [(trip, "5-S1", step, "verdict", "P0106")] if step else []
    rows += [("both", "1-S2", "triggered", "verdict", "P0217"), ("both", "1-S3", "pending", "pending_precursor", None), ("both", "1-S4", "triggered", "support", "P0116"), ("both", "3-S1b", "pass", "verdict", "P2138")]
    capped = spark.createDataFrame([("both",), ("both",)], "trip_id string")
    got = {(r["trip_id"], r["sub_check_id"]): r for r in d.routed(table(spark, rows), capped).collect()}
    assert len(got) == len(rows) and list(d.COLUMNS) == d.routed(table(spark, rows), capped).columns
    for trip, (flat, step, attribution, code) in cases.items():
        for sub in ("2-S2", "5-S2"):
            r = got[trip, sub]
            assert (r["routing_attribution"], r["routed_dtc"], r["dtc_emitted"]) == (attribution, code, sub == "2-S2"), trip
            assert (r["confidence"], r["confidence_capped_low"]) == (("low", True) if trip == "both" else ("high", False))
        assert (got[trip, "2-S3b"]["routing_attribution"], got[trip, "2-S3b"]["routed_dtc"], got[trip, "2-S3b"]["dtc_emitted"], got[trip, "2-S3b"]["confidence"]) == ("direct", "P0102", True, "high")
        assert got[trip, "5-S3"]["dtc_emitted"] == (flat == "triggered") and got[trip, "5-S3"]["routed_dtc"] == ("P0106" if flat == "triggered" else None)
    assert got["both", "1-S2"]["routed_dtc"] == "P0217" and got["both", "1-S2"]["proxy_id"] == "cooling_degradation"
    assert not got["both", "1-S3"]["dtc_emitted"] and not got["both", "1-S4"]["dtc_emitted"] and got["both", "1-S4"]["routed_dtc"] is None
    assert got["both", "1-S4"]["confidence"] == "low" and got["both", "3-S1b"]["confidence"] == "provisional"


def test_start_tree(spark):
    base = dict(trip_id="t", segment_id="s", start_t=0, end_t=9, guards=True, in_domain=True, budget_s=100.0, reached_s=100.0, censored=False, heat_passed=True, support_evaluable=True, support_exceed=False, support_reason=None)
    soak = {"support_evaluable": False, "support_exceed": None, "support_reason": "cold_soak_gap_unavailable"}
    gone = {"support_evaluable": False, "support_exceed": None, "support_reason": "cold_soak_unavailable"}
    late = {"reached_s": 100.5}
    cases = {
        "start_guards_failed": {"guards": False}, "budget_out_of_domain": {"in_domain": False}, "support_triggered_sensor_untrusted": {"support_exceed": True}, "target_reached_within_budget": {},
        "support_cold_soak_unavailable_pass_forbidden": soak, "support_not_evaluable": gone, "right_censored": {"reached_s": None, "censored": True}, "insufficient_heat_input": late | {"heat_passed": None},
        "budget_expired_below_target": late | soak,
    }
    rows = [Row(**(base | {"episode_id": why} | change)) for why, change in cases.items()] + [Row(**(base | {"episode_id": "late"} | late | gone)), Row(**(base | {"episode_id": "never", "reached_s": None}))]
    schema = "trip_id string, segment_id string, start_t long, end_t long, guards boolean, in_domain boolean, budget_s double, reached_s double, censored boolean, heat_passed boolean, support_evaluable boolean, support_exceed boolean, support_reason string, episode_id string"
    got = {r["episode_id"]: r for r in starts.start_decisions(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[why]["decision_reason"] == why for why in cases)
    assert got["late"]["decision_reason"] == "support_not_evaluable" and got["never"]["decision_reason"] == "budget_expired_below_target" and got["never"]["decision_margin"] is None
    assert (got["target_reached_within_budget"]["result_state"], got["target_reached_within_budget"]["decision_margin"]) == ("pass", 0.0)
    assert (got["budget_expired_below_target"]["result_state"], got["budget_expired_below_target"]["decision_margin"]) == ("triggered", 0.5)


def test_cap_runs_from_the_start_to_the_end_of_its_block(spark):
    def rows(segment, begin, iat, coolant, n=12, start=4, bad=9):
        return [(segment, i, begin + i, 900.0 if i >= start else 0.0, coolant, 10.0, iat, i != bad) for i in range(1, n + 1)]

    data = rows("s0", 0, 12.0, 10.0) + rows("s1", 30_000, 18.0, 20.0) + rows("s2", 60_000, 17.0, 40.0) + rows("s3", 90_000, 18.0, 40.0) + rows("s4", 120_000, 12.0, 11.0, start=1) + rows("s5", 120_100, 12.0, 11.0) + rows("s6", 150_000, 12.0, 11.0, start=11)
    df = spark.createDataFrame([("t", *r) for r in data], "trip_id string, segment_id string, row_in_segment int, t long, rpm double, coolant_temp double, ambient_temp double, intake_temp double, rpm_ok boolean")
    df = df.withColumns({f"{x}_ok": F.lit(True) for x in ("coolant_temp", "ambient_temp", "intake_temp")})
    cold = {r["segment_id"]: r for r in starts.cold_start(df).collect()}
    assert {s: r["reason"] for s, r in cold.items()} == {"s0": "cold_soak_gap_unavailable", "s1": "iat_witness_failed", "s2": None, "s3": "iat_witness_failed", "s4": "first_row_engine_on", "s5": "cold_soak_gap_unavailable", "s6": "no_observed_start_in_block"}
    assert (cold["s1"]["cap_start_row"], cold["s1"]["cap_end_row"], cold["s1"]["cap_start_t"], cold["s1"]["cap_end_t"]) == (4, 8, 30_004, 30_008)
    assert all(cold[s]["cap_start_row"] is None for s in cold if s != "s1")
    assert (cold["s2"]["s1s4_exceed"], cold["s2"]["s4s2_eligible"], cold["s2"]["s4s2_exceed"]) == (True, False, None)  # 7 degrees are within, 30 are not
    got = {(r["segment_id"], r["sub_check_id"]): r for r in starts.cold_decisions(starts.cold_start(df)).collect()}
    assert (got["s1", "4-S2"]["result_state"], got["s1", "4-S2"]["decision_margin"]) == ("triggered", 1.0) and got["s3", "4-S2"]["decision_reason"] == "iat_witness_failed"
    assert (got["s2", "1-S4"]["result_state"], got["s2", "1-S4"]["decision_margin"]) == ("triggered", pytest.approx(15.0)) and got["s2", "4-S2"]["decision_reason"] == "witness_or_quality_failed"
