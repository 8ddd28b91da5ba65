"""Audit of a cleaning run on rows typed by hand."""

import os

import pytest

from roadlens.operators import ingest as i
from roadlens.operators import quality as q
from roadlens.plans.registry import queries

FIELDS = ("rpm", "speed", "maf", "coolant_temp", "ambient_temp")


def raw(spark):
    s = 1_000_000
    rows = [("b.csv", 1, 10 * s, "900", "1"), ("b.csv", 2, 10 * s, "-5", "2"), ("b.csv", 3, 11 * s, "x", "300"), ("b.csv", 4, 16 * s, None, "4"), ("b.csv", 5, 15 * s, "0", "5"), ("a.csv", 6, 40 * s, "800", None), ("a.csv", 7, None, "y", "-1")]
    df = spark.createDataFrame([(f, n, us, rpm, speed, "1", None, "20") for f, n, us, rpm, speed in rows], "file string, row long, us long, rpm string, speed string, maf string, coolant_temp string, ambient_temp string")
    return df


def test_reports_of_a_run(spark):
    df = raw(spark)
    trips, files = i.trips_of(df), q.raw_files(df, FIELDS)
    cleaned = i.clean(df, trips, FIELDS)
    got = {r["file"]: r.asDict() for r in q.file_report(files, trips, cleaned, FIELDS).collect()}
    assert got["b.csv"] == {"file": "b.csv", "trip_id": "trip_0001", "input_rows": 5, "deduplicated_rows": 4, "duplicate_rows": 2, "output_rows": 4, "segments": 2, "max_gap_seconds": 4.0, "monotonic": False, "failures": 1, "invalid": 2}
    assert got["a.csv"]["max_gap_seconds"] == 0.0 and got["a.csv"]["monotonic"] and got["a.csv"]["failures"] == 0
    by = {(r["file"], r["field"]): (r["failures"], r["invalid"], r["missing"], r["runs"], r["longest"]) for r in q.file_field_report(files, trips, cleaned, FIELDS).collect()}
    assert by["b.csv", "rpm"] == (1, 1, 2, 1, 2)  # empty from 10 to 11; 15 holds 0, which fills 16
    assert by["b.csv", "speed"] == (0, 1, 1, 1, 1) and by["b.csv", "coolant_temp"] == (0, 0, 4, 1, 4)  # one run across both segments
    segment = {r["segment_id"]: r for r in q.segment_report(cleaned, FIELDS).collect()}
    assert segment["trip_0001_seg_002"]["rpm_zero_while_speed_positive"] == 2 and segment["trip_0001_seg_002"]["imputed"] == 1
    whole = {(r["measure"], r["field"]): r["value"] for r in q.global_report(files, cleaned.unionByName(cleaned.where("t = 15")), FIELDS).collect()}
    assert whole["trips", None] == 2 and whole["segments", None] == 3 and whole["duplicate_key_rows", None] == 2 and whole["steps_not_one_second", None] == 1
    assert whole["physical_invalid_removed", "rpm"] == 1 and whole["input_rows", None] == 6


def test_empty_run_and_flat_fields(spark):
    df = raw(spark).limit(0)
    trips, files = i.trips_of(df), q.raw_files(df, FIELDS)
    cleaned = i.clean(df, trips, FIELDS)
    assert q.file_report(files, trips, cleaned, FIELDS).count() == 0 and q.segment_report(cleaned, FIELDS).count() == 0
    assert all(r["value"] == 0 for r in q.global_report(files, cleaned, FIELDS).collect())
    flat = spark.createDataFrame([("t1", 1.0, None, False, False, False, False), ("t1", 1.0, None, True, False, False, True)], "trip_id string, a double, b double, a_is_imputed boolean, b_is_imputed boolean, a_is_suspicious boolean, b_is_suspicious boolean")
    got = {r["field"]: r for r in q.field_matrix(flat, ("a", "b")).collect()}
    assert got["a"]["outliers"] == 0 and got["a"]["imputed"] == 1 and got["b"]["missing_rate"] == 1.0 and got["b"]["suspicious"] == 1
    assert q.outliers_by_trip(flat, ("a", "b")).count() == 0
    assert q.field_matrix(flat.limit(0), ("a",)).first()["missing_rate"] is None


def test_ties_of_outliers(spark):
    rows = [(f"t{n % 3}", 1000.0 if n < 6 else 1.0) for n in range(600)]
    got = [(r["place"], r["trip_id"], r["outliers"]) for r in q.outliers_by_trip(spark.createDataFrame(rows, "trip_id string, a double"), ("a",), top=2).orderBy("place").collect()]
    assert got == [(1, "t0", 2), (2, "t1", 2)]


def test_reports_deal_out_no_cells_and_sort_once(spark):
    """Runs of empty cells without a row a cell (F2); order and repeated times of a file from one sort (F1, F2)."""
    df = raw(spark)
    runs = q.missing_runs(i.clean(df, i.trips_of(df), FIELDS).select("trip_id", "t", "segment_id", *FIELDS).localCheckpoint(), FIELDS)
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.index("Generate") < plan.index("Aggregate [")
    assert {(r["trip_id"], r["field"]): (r["missing"], r["runs"], r["longest"]) for r in runs.collect()}["trip_0001", "coolant_temp"] == (4, 1, 4)
    plan = q.raw_files(df, FIELDS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_global_report_reads_the_run_twice_only(spark):
    """Once for its cells, once for its keys (F1)."""
    plan = queries()["a03_global_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert 0 < plan.count("FileScan parquet") <= 3
