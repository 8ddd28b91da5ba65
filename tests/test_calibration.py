"""Re-fits, leave-one-out and threshold choice against brute force on small tables."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.operators import calibration as c
from roadlens.operators.ranks import running_totals
from roadlens.plans.registry import queries


def trips(seed, sizes, ties):
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(sizes):
        for v in rng.integers(0, 12, n) if ties else rng.standard_normal(n) * 10:
            rows.append((f"t{i:02d}", float(v), float(rng.standard_normal())))
    return [*rows, ("t00", None, 1.0), ("zz", None, None)]


@pytest.mark.parametrize("ties, sizes", [(True, [400, 3, 1, 20, 20, 9]), (False, [60, 1, 1, 200, 17, 5]), (True, [1, 1])])
def test_leave_one_out_as_brute_force(spark, ties, sizes):
    rows = trips(len(sizes), sizes, ties)
    df = spark.createDataFrame(rows, "trip_id string, v double, w double").repartition(5)
    named = sorted({t for t, v, _ in rows if v is not None})
    rest = {t: np.array([v for o, v, _ in rows if o != t and v is not None]) for t in [*named, "zz"]}
    for q in (0.005, 0.5, 1.0):
        got = {r["left_out_trip"]: r["recalculated"] for r in c.leave_one_out(df, c.Quantile("v", q), 1.0).collect()}
        assert sorted(got) == named and all(got[t] == pytest.approx(np.quantile(rest[t], q), abs=1e-9) for t in named)
    got = {r["left_out_trip"]: r for r in c.leave_one_out(df, c.mean_of("v"), 2.0, 0.5).collect()}
    assert set(got) == {*named, "zz"}
    for t, r in got.items():
        assert r["recalculated"] == pytest.approx(rest[t].mean()) and r["passes"] == (abs(r["recalculated"] - 2.0) <= 0.5)
    got = {r["left_out_trip"]: r["recalculated"] for r in c.leave_one_out(df, c.maximum_of("v"), 2.0).collect()}
    assert all(got[t] == rest[t].max() for t in rest)
    pairs = {t: np.array([(v, w) for o, v, w in rows if o != t and v is not None]) for t in rest}
    got = {r["left_out_trip"]: r["recalculated"] for r in c.leave_one_out(df, c.slope_of("v", "w"), 2.0).collect()}
    for t, xy in pairs.items():
        want = np.polyfit(xy[:, 1], xy[:, 0], 1)[0] if len(xy) > 1 else None
        assert got[t] == (want if want is None else pytest.approx(want, abs=1e-7))


def test_nothing_is_taken_off_again(spark):
    """A sum less an own value of 1e20 would have lost the others."""
    df = spark.createDataFrame([("a", 1e20), ("b", 1.0), ("c", 2.0)], "trip_id string, v double")
    got = {r["left_out_trip"]: r["recalculated"] for r in c.leave_one_out(df, c.mean_of("v"), 1.0).collect()}
    assert got["a"] == 1.5
    alone = c.leave_one_out(df.where("trip_id = 'a'"), c.mean_of("v"), 1.0).collect()
    assert len(alone) == 1 and alone[0]["recalculated"] is None
    assert c.leave_one_out(df.where("false"), c.Quantile("v", 0.5), 1.0).count() == 0


def test_running_totals_of_groups_over_ranges(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(7)
    got = {r["i"]: (r["n"], r["s"]) for r in running_totals(df, ("i",), {"n": F.lit(1).cast("long"), "s": F.col("i")}, by=("g",)).collect()}
    for g, i in rows:
        own = [j for h, j in rows if h == g and j <= i]
        assert got[i] == (len(own), sum(own))


def test_least_squares_as_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3)) * [1, 50, 0.01] + [1000, -3, 7]
    y = 4 + x @ [2.0, -0.5, 30.0] + 0.1 * rng.standard_normal(400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double")
    inputs = {n: F.col(n) for n in "abc"}
    n, got, intercept = c.least_squares(df, inputs, F.col("y"), {"a": 1000.0})
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    assert n == 400 and [intercept, *got.values()] == pytest.approx(list(want), rel=1e-6)
    n, got, intercept = c.least_squares(df, {"a": F.col("a"), "same": F.col("a"), "flat": F.lit(3.0)}, F.col("y"))
    assert got["a"] == pytest.approx(got["same"]) and got["flat"] == 0.0
    assert c.least_squares(df.where("false"), inputs, F.col("y"))[0] == 0


TYPES = ("p", "q")


def metrics(rows, threshold):
    said = [(e, a if s is not None and s >= threshold else None) for e, a, s in rows]
    part = lambda a, b: a / b if b else 0.0
    tp = [sum(e == t == a for e, a in said) for t in TYPES]
    al, every = [sum(a == t for _, a in said) for t in TYPES], [sum(e == t for e, _ in said) for t in TYPES]
    p, r = part(sum(tp), sum(al)), part(sum(tp), sum(every))
    healthy, injected = [a for e, a in said if e is None], [(e, a) for e, a in said if e is not None]
    alarms = sum(a is not None for a in healthy)
    return (
        sum(part(2 * x, a + e) for x, a, e in zip(tp, al, every)) / 2, part(2 * p * r, p + r), part(sum(e == a for e, a in injected), len(injected)), part(alarms, len(healthy)), alarms, len(healthy)
    )


def test_threshold_sweep_as_brute_force(spark):
    rng = np.random.default_rng(2)
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows = [(pick([None, "p", "q"]), pick(["p", "q", "no_alarm"]), pick([0.0, 0.1, 0.25, 0.4, 0.400001, 0.9, 1.0, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "expected string, anomaly_type string, risk_score double")
    got = {r["threshold"]: tuple(r)[1:] for r in c.threshold_metrics(df, TYPES).collect()}
    assert sorted(got) == [0.0, 0.1, 0.25, 0.4, 0.400001, 0.9, 1.0, math.nextafter(1.0, 2.0)]
    for t, m in got.items():
        assert m == pytest.approx(metrics(rows, t))
    best = max((t for t in got if got[t][3] <= 0.1), key=lambda t: (got[t][0], got[t][2], -got[t][3], -t))
    assert c.choose_threshold(c.threshold_metrics(df, TYPES)).first()["threshold"] == best


def test_ties_of_the_choice(spark):
    row = lambda t, f1, hit, fpr: (t, f1, 0.0, hit, fpr, 0, 10)
    schema = "threshold double, macro_f1 double, micro_f1 double, exact_hit_rate double, healthy_false_positive_rate double, healthy_alarms long, healthy_runs long"
    pick = lambda *rows: c.choose_threshold(spark.createDataFrame(list(rows), schema)).first()
    assert pick(row(0.2, 0.9, 0.9, 0.11), row(0.5, 0.4, 0.4, 0.1))["threshold"] == 0.5
    assert pick(row(0.2, 0.5, 0.3, 0.0), row(0.5, 0.5, 0.4, 0.1))["threshold"] == 0.5
    assert pick(row(0.2, 0.5, 0.4, 0.1), row(0.5, 0.5, 0.4, 0.05))["threshold"] == 0.5
    assert pick(row(0.5, 0.5, 0.4, 0.1), row(0.2, 0.5, 0.4, 0.1))["threshold"] == 0.2
    assert pick(row(0.5, 0.5, 0.4, 0.2)) is None


def test_checks_without_samples_are_incomplete(spark):
    schema = "trip_id string, " + ", ".join(f"{x} double" for x in ("rpm", "coolant_temp", "ambient_temp", "intake_temp", "pedal_slope", "segment_gap_seconds", "speed_density_maf_residual", "pedal_mapping_residual", "accel_pedal_channel_delta", "speed_std", "maf_std", "rpm_std", "accel_pedal_mean_std"))
    schema += ", row_in_segment int, thermal_state string, operating_state string, condition_confidence string"
    got = c.rederived(spark.createDataFrame([], schema), c.published_checks()).collect()
    assert len(got) == 19 and {r["status"] for r in got} == {"INCOMPLETE"} and {r["n"] for r in got} == {0}
    base = dict(trip_id="a", rpm=900.0, coolant_temp=105.0, ambient_temp=10.0, thermal_state="post_warmup", row_in_segment=2)
    got = {r["param"]: r for r in c.rederived(spark.createDataFrame([base, base | {"trip_id": "b", "rpm": 50.0, "coolant_temp": 60.0}], schema), c.published_checks()).collect()}
    assert got["engine_on_rpm_value"]["status"] == "PASS" and got["thermostat_regulating_estimate_c"]["rederived"] == 82.5
    assert got["tier_high_temperature_c"]["status"] == "FAIL"  # the limit must lie above the healthy maximum, not on it
    assert got["tier_critical_temperature_c"]["status"] == "PASS"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_counts_are_taken_where_trips_are(spark):
    """Of samples dealt out by trip no count is dealt out by trip again, and a check of extremes is a row a trip (F9)."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/measures-*"))
    assert queries()["c03_rederived_thresholds"](spark, "/root/testdata/sf0.001").count() == 19
    (made,) = set(glob.glob(f"{folder}/measures-*")) - before
    folded = spark.read.parquet(made)
    ends = folded.where("v is null").groupBy("measure", "trip_id").count()
    assert 0 < ends.count() == ends.where("count = 1").count() and folded.where("v is null and (low is null or high is null)").isEmpty()
    assert folded.groupBy("measure", "trip_id").agg((F.sum("c") == F.max("n")).alias("whole"), F.count_if("first").alias("first")).where("not whole or first <> 1").isEmpty()
