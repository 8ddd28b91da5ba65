"""Queries of the audit of a cleaning run (A-02, A-03, A-26, A-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import ingest as i
from roadlens.operators import quality as q
from roadlens.plans.ingest import CLEAN, FIELDS, LIMITS, dealt_recordings
from roadlens.plans.registry import query
from roadlens.plans.sql import SEG, with_ticks
from roadlens.sources.adapters import RECORDINGS_SQL, ticks
from roadlens.sources.scratch import written

_IN = {f: (lo, hi) for f, (lo, hi, *_) in LIMITS.items()}
_OUT = lambda f: f"TRY_CAST({f} AS DOUBLE) NOT BETWEEN {_IN[f][0]} AND {_IN[f][1]}"
_FILES = f"""kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, us ORDER BY row DESC) AS k, count(*) OVER (PARTITION BY file, us) AS same FROM rc) WHERE k = 1),
kg AS (SELECT file, max((us - before) / 1000000.0) AS gap, count(*) AS n, CAST(coalesce(sum(same) FILTER (same > 1), 0) AS BIGINT) AS twice, {", ".join(f"count(*) FILTER ({_OUT(f)}) AS {f}_invalid" for f in FIELDS)} FROM (SELECT *, lag(us) OVER (PARTITION BY file ORDER BY us) AS before FROM kp) GROUP BY file),
ko AS (SELECT file, count(*) AS input_rows, NOT bool_or(coalesce(us < before, FALSE)) AS monotonic, {", ".join(f"count(*) FILTER ({f} IS NOT NULL AND TRY_CAST({f} AS DOUBLE) IS NULL) AS {f}_failures" for f in FIELDS)} FROM (SELECT *, lag(us) OVER (PARTITION BY file ORDER BY row) AS before FROM rc) GROUP BY file)"""
_SQL = f"WITH {RECORDINGS_SQL}, {CLEAN}, {_FILES}"


def _inputs(spark, sf_dir):
    raw = dealt_recordings(spark, sf_dir)
    trips = i.trips_of(raw)
    return written(q.raw_files(raw, FIELDS), "files"), trips, written(i.clean(raw, trips, FIELDS), "cleaned")


@query(
    f"""{_SQL}, oc AS (SELECT trip_id, count(*) AS output_rows, count(DISTINCT segment_id) AS segments FROM cl GROUP BY trip_id)
SELECT file, trip_id, input_rows, n AS deduplicated_rows, twice AS duplicate_rows, output_rows, segments, CAST(coalesce(gap, 0) AS DOUBLE) AS max_gap_seconds, monotonic,
 {" + ".join(f"{f}_failures" for f in FIELDS)} AS failures, {" + ".join(f"{f}_invalid" for f in FIELDS)} AS invalid FROM ko JOIN kg USING (file) JOIN tr USING (file) JOIN oc USING (trip_id)"""
)
def a02_file_report(spark, sf_dir):
    return q.file_report(*_inputs(spark, sf_dir), FIELDS)


def _runs_sql(f: str) -> str:
    return f"""SELECT trip_id, '{f}' AS field, CAST(sum(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(DISTINCT CASE WHEN {f} IS NULL THEN isl END) AS runs, max(len) AS longest FROM (
 SELECT *, count(*) FILTER ({f} IS NULL) OVER (PARTITION BY trip_id, isl) AS len FROM (SELECT *, sum(CASE WHEN {f} IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY trip_id ORDER BY t, segment_id) AS isl FROM cl)) GROUP BY trip_id"""


@query(
    f"""{_SQL}, mr AS ({" UNION ALL ".join(_runs_sql(f) for f in FIELDS)}),
lost AS ({" UNION ALL ".join(f"SELECT file, '{f}' AS field, {f}_failures AS failures, {f}_invalid AS invalid FROM ko JOIN kg USING (file)" for f in FIELDS)})
SELECT file, field, failures, invalid, missing, runs, longest FROM lost JOIN tr USING (file) JOIN mr USING (trip_id, field)"""
)
def a02_file_field_report(spark, sf_dir):
    return q.file_field_report(*_inputs(spark, sf_dir), FIELDS)


_each = lambda flag: " + ".join(f"CAST({f}_{flag} AS BIGINT)" for f in FIELDS)


@query(
    f"""WITH {RECORDINGS_SQL}, {CLEAN} SELECT trip_id, segment_id, CAST(sum(source_sample_count) AS BIGINT) AS input_rows, count(*) AS output_rows, min(t) AS start_t, max(t) AS end_t, min(source_sample_count) AS samples_min, max(source_sample_count) AS samples_max,
 CAST(sum({_each("is_imputed")}) AS BIGINT) AS imputed, CAST(sum({_each("is_suspicious")}) AS BIGINT) AS suspicious, CAST(sum({_each("had_hard_invalid_source")}) AS BIGINT) AS hard_invalid_bins,
 count(*) FILTER (rpm = 0 AND speed > 0) AS rpm_zero_while_speed_positive, count(*) FILTER (maf = 0 AND rpm > 0) AS maf_zero_while_rpm_positive, count(*) FILTER (coolant_temp < 0 AND ambient_temp > 5) AS coolant_below_zero_in_warm_ambient
FROM cl GROUP BY trip_id, segment_id"""
)
def a02_segment_report(spark, sf_dir):
    raw = dealt_recordings(spark, sf_dir)
    return q.segment_report(i.clean(raw, i.trips_of(raw), FIELDS), FIELDS)


def _global_sql() -> str:
    rows = ["SELECT 'files' AS measure, NULL AS field, count(*) AS value FROM ko", "SELECT 'input_rows', NULL, CAST(sum(input_rows) AS BIGINT) FROM ko", "SELECT 'output_rows', NULL, count(*) FROM sp", "SELECT 'trips', NULL, count(DISTINCT trip_id) FROM sp", "SELECT 'segments', NULL, count(DISTINCT segment_id) FROM sp"]
    rows += ["SELECT 'duplicate_key_rows', NULL, CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM sp GROUP BY trip_id, segment_id, t HAVING count(*) > 1)"]
    rows += ["SELECT 'steps_not_one_second', NULL, count(*) FROM (SELECT t - lag(t) OVER (PARTITION BY segment_id ORDER BY t) AS d FROM sp) WHERE d <> 1"]
    rows += [f"SELECT 'physical_invalid_removed', '{f}', CAST(sum({f}_invalid) AS BIGINT) FROM kg" for f in FIELDS]
    rows += [f"SELECT '{flag}', '{f}', count(*) FILTER ({f}_{flag}) FROM sp" for flag in ("is_imputed", "is_suspicious", "had_hard_invalid_source") for f in FIELDS]
    rows += [f"SELECT 'missing', '{f}', count(*) FILTER ({f} IS NULL) FROM sp" for f in FIELDS]
    rows += [f"SELECT 'rows_{x}', NULL, count(*) FILTER ({x}) FROM sp" for x in ("is_imputed_any", "is_suspicious_any", "had_hard_invalid_source_any")]
    return " UNION ALL ".join(rows)


@query(f"{_SQL}, sp AS (SELECT * FROM cl WHERE row_in_segment % 37 <> 11 UNION ALL SELECT * FROM cl WHERE row_in_segment % 41 = 5) {_global_sql()}")
def a03_global_report(spark, sf_dir):
    """The report of a run whose output has been spoilt: some seconds taken out, some written twice."""
    files, _, cleaned = _inputs(spark, sf_dir)
    copies = F.when(F.expr("row_in_segment % 37 <> 11"), 1).otherwise(0) + F.when(F.expr("row_in_segment % 41 = 5"), 1).otherwise(0)
    spoilt = cleaned.select("*", F.explode(F.array_repeat(F.lit(True), copies)).alias("_copy")).drop("_copy")  # read once
    return q.global_report(files, spoilt, FIELDS)


_MOMENTS = "gm AS (SELECT " + ", ".join(f"avg({f}) AS {f}_m, stddev_samp({f}) AS {f}_s" for f in FIELDS) + " FROM ticks)"


@query(
    with_ticks(_MOMENTS)
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, min({f}) AS min, max({f}) AS max, count(*) - count({f}) AS missing, round((count(*) - count({f})) / count(*), 9) AS missing_rate, count(*) FILTER (abs({f} - {f}_m) / {f}_s > 3) AS outliers,"
        f" count(*) FILTER ({f}_is_imputed) AS imputed, count(*) FILTER ({f}_is_suspicious) AS suspicious FROM ticks, gm"
        for f in FIELDS
    )
)
def a26_field_matrix(spark, sf_dir):
    return q.field_matrix(ticks(spark, sf_dir), FIELDS).withColumn("missing_rate", F.round("missing_rate", 9))


@query(
    with_ticks(_MOMENTS, "ot AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, trip_id, count(*) AS outliers FROM ticks, gm WHERE abs({f} - {f}_m) / {f}_s > 3 GROUP BY trip_id" for f in FIELDS) + ")")
    + "SELECT field, trip_id, outliers, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY outliers DESC, trip_id) AS INTEGER) AS place FROM ot) WHERE place <= 5"
)
def a27_outliers_by_trip(spark, sf_dir):
    return q.outliers_by_trip(ticks(spark, sf_dir), FIELDS)


_JUMPS = {"coolant_temp": 5.0, "intake_temp": 30.0, "rpm": 1500.0}


@query(
    with_ticks("jp AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, segment_id, coalesce(abs({f} - lag({f}) OVER ({SEG})) > {x}, FALSE) AS j FROM ticks" for f, x in _JUMPS.items()) + ")")
    + "SELECT field, count(*) FILTER (j) AS jumps, count(DISTINCT segment_id) FILTER (j) AS segments FROM jp GROUP BY field"
)
def a27_jumps(spark, sf_dir):
    return q.jumps(ticks(spark, sf_dir), _JUMPS)
