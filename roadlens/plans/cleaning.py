"""Queries of cleaning and operating conditions (S-05, T-02, P-*, A-01, A-05, A-06, W-08, W-09, W-23, X-04 to X-06, D-01 to D-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import cleaning as c
from roadlens.operators import conditions as o
from roadlens.operators.continuity import KEYS as KEY
from roadlens.operators.continuity import segment_by_gap
from roadlens.plans.registry import query
from roadlens.plans.sql import KEYS, SEG, with_irregular, with_ticks
from roadlens.sources.adapters import irregular, table, ticks


def _raw(spark, sf_dir):
    """Events as a recording: errors carry no value, signups two readings in one second."""
    df = irregular(spark, sf_dir)
    return df.withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("second", F.floor(F.col("us") / 1_000_000).cast("long"))


_RAW = "rawev AS (SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN value END AS value), CAST(floor(us / 1000000) AS BIGINT) AS second FROM irregular)"
_SEG = """sg AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY trip_id ORDER BY us, event_id) > 43200000000 THEN 1 ELSE 0 END AS b FROM rawev),
sgm AS (SELECT *, CAST(sum(b) OVER (PARTITION BY trip_id ORDER BY us, event_id) + 1 AS BIGINT) AS segment, CAST(floor(us / 3600000000) AS BIGINT) AS bin FROM sg)"""
_BIN = "bins AS (SELECT trip_id, segment, bin, arg_max(value, (us, event_id)) FILTER (value IS NOT NULL) AS value, count(*) AS samples, count(value) AS observed FROM sgm GROUP BY ALL)"
_DENSE = """den AS (SELECT w.trip_id, w.segment, w.bin, value, samples, observed FROM (SELECT trip_id, segment, unnest(range(min(bin), max(bin) + 1)) AS bin FROM bins GROUP BY trip_id, segment) w
 LEFT JOIN bins USING (trip_id, segment, bin))"""


@query(with_irregular(_RAW) + "SELECT trip_id, us, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM (SELECT *, us AS u FROM (SELECT * REPLACE (CAST(floor(us / 86400000000) AS BIGINT) AS us) FROM rawev)) GROUP BY trip_id, us")
def t02_dedupe_last(spark, sf_dir):
    df = _raw(spark, sf_dir).select("trip_id", F.floor(F.col("us") / 86_400_000_000).cast("long").alias("us"), "event_id", "event_type")
    return c.dedupe_last(df, ("trip_id", "us"), "event_id")


def _bins(spark, sf_dir):
    return c.resample(segment_by_gap(_raw(spark, sf_dir), 12 * 3600.0), "value", 3600)


@query(with_irregular(_RAW, _SEG, _BIN) + "SELECT * FROM bins")
def a01_resample(spark, sf_dir):
    return _bins(spark, sf_dir)


@query(with_irregular(_RAW, _SEG, _BIN, _DENSE) + "SELECT * FROM den")
def w08_densify(spark, sf_dir):
    return c.densify(_bins(spark, sf_dir))


_P = "PARTITION BY trip_id, segment ORDER BY bin"


@query(
    with_irregular(
        _RAW, _SEG, _BIN, _DENSE,
        f"""ff AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS t0, first_value(value IGNORE NULLS) OVER n AS v1,
 first_value(CASE WHEN value IS NOT NULL THEN bin END IGNORE NULLS) OVER n AS t1, count(value) OVER b AS g FROM den WINDOW b AS ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS ({_P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fr AS (SELECT *, count(*) FILTER (value IS NULL) OVER (PARTITION BY trip_id, segment, g) AS run FROM ff),
fn AS (SELECT *, CASE WHEN value IS NULL AND run <= 2 THEN v0 + (v1 - v0) * (bin - t0) / (t1 - t0) END AS nv FROM fr)""",
    )
    + "SELECT trip_id, segment, bin, round(coalesce(value, nv), 6) AS value_filled, value IS NULL AND nv IS NOT NULL AS value_is_imputed FROM fn"
)
def w09_fill_short(spark, sf_dir):
    df = c.fill_short(c.densify(_bins(spark, sf_dir)), "value")
    return df.select("trip_id", "segment", "bin", F.round("value_filled", 6).alias("value_filled"), "value_is_imputed")


_FLAGGED = ("coolant_temp", "map", "rpm", "speed", "intake_temp", "maf")


def _flags_sql() -> str:
    bounds = {"coolant_temp": (-40, 215, -20, 125), "map": (0, 255, 20, 250), "rpm": (0, 16383.75, 0, 7000), "speed": (0, 255, 0, 220), "intake_temp": (-40, 215, -30, 100), "maf": (0, 655.35, 0, 200)}
    parts = []
    for s in _FLAGGED:
        lo, hi, slo, shi = bounds[s]
        parts.append(f"CASE WHEN {s} NOT BETWEEN {lo} AND {hi} THEN '{s}_hard_invalid' END")
        parts.append(f"CASE WHEN ({s} NOT BETWEEN {slo} AND {shi}{" OR intake_temp IN (-40, 150)" if s == "intake_temp" else ""}) AND {s} BETWEEN {lo} AND {hi} THEN '{s}_suspicious' END")
    parts += ["CASE WHEN rpm = 0 AND speed > 0 THEN 'rpm_zero_while_speed_positive' END", "CASE WHEN maf = 0 AND rpm > 0 THEN 'maf_zero_while_rpm_positive' END", "CASE WHEN coolant_temp < 0 AND ambient_temp > 5 THEN 'coolant_below_zero_in_warm_ambient' END"]
    return f"coalesce(nullif(concat_ws('|', {', '.join(parts)}), ''), 'OK')"


@query(with_ticks() + f"SELECT {KEYS}, {_flags_sql()} AS quality_flags FROM ticks")
def p02_p03_p04_p07_quality_flags(spark, sf_dir):
    return ticks(spark, sf_dir).select(*KEY, c.quality_flags(_FLAGGED).alias("quality_flags"))


@query(
    with_ticks()
    + f"""SELECT {KEYS}, concat_ws('|', CASE WHEN speed IS NULL THEN 'missing_speed' END, CASE WHEN rpm IS NULL THEN 'missing_rpm' END, CASE WHEN coolant_temp IS NULL THEN 'missing_coolant_temp' END,
 CASE WHEN maf IS NULL THEN 'missing_maf' END, CASE WHEN intake_temp IS NULL THEN 'missing_intake_temp' END, CASE WHEN ambient_temp IS NULL THEN 'missing_ambient_temp' END) AS issues,
 CASE WHEN speed IS NULL OR rpm IS NULL THEN 'low' WHEN coolant_temp IS NULL OR maf IS NULL OR intake_temp IS NULL OR ambient_temp IS NULL THEN 'medium' ELSE 'high' END AS confidence FROM ticks"""
)
def p08_confidence(spark, sf_dir):
    return ticks(spark, sf_dir).select(*KEY, F.array_join(o.quality_issues(), "|").alias("issues"), o.confidence().alias("confidence"))


_NAMES = "nm AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '_Seat_Leon_' || chr(CAST(65 + o_custkey % 26 AS INTEGER)) || '_' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || CASE WHEN o_orderkey % 5 = 0 THEN '_2' ELSE '' END || CASE o_orderkey % 4 WHEN 0 THEN '_Frei' WHEN 1 THEN '_Normal' WHEN 2 THEN '_Stau' ELSE '_Other' END || CASE WHEN o_orderkey % 7 = 0 THEN '_x_y' ELSE '' END || '.csv' AS name FROM orders)"


@query(
    f"WITH {_NAMES}, p AS (SELECT o_orderkey, string_split(regexp_replace(name, '\\.csv$', ''), '_') AS p FROM nm), q AS (SELECT *, p[6:] AS rest FROM p),"
    " r AS (SELECT *, greatest(coalesce(list_position(rest, 'Frei'), 0), coalesce(list_position(rest, 'Normal'), 0), coalesce(list_position(rest, 'Stau'), 0)) AS a FROM q)"
    " SELECT o_orderkey, CASE WHEN a > 0 THEN p[1] END AS date, CASE WHEN a > 0 THEN p[4] END AS origin, CASE WHEN a > 0 THEN p[5] END AS destination,"
    " CASE WHEN a > 0 THEN nullif(array_to_string(rest[1 : a - 1], '_'), '') END AS sequence, CASE WHEN a > 0 THEN rest[a] END AS condition, CASE WHEN a > 0 THEN nullif(array_to_string(rest[a + 1 :], '_'), '') END AS extension FROM r"
)
def s05_parse_filename(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    letter = lambda x: F.chr((65 + x % 26).cast("int"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("_Frei", "_Normal", "_Stau", "_Other")]), (k % 4 + 1).cast("int"))
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_Seat_Leon_"), letter(F.col("o_custkey")), F.lit("_"), letter(k), F.when(k % 5 == 0, "_2").otherwise(""), label, F.when(k % 7 == 0, "_x_y").otherwise(""), F.lit(".csv"))
    f = d.select("o_orderkey", c.parse_filename(name).alias("f"))
    return f.select("o_orderkey", F.col("f.date").cast("string").alias("date"), "f.origin", "f.destination", "f.sequence", "f.condition", "f.extension")


_MOTION = f"""m1 AS (SELECT *, t - lag(t) OVER ({SEG}) AS d, avg(speed) OVER ({SEG} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM ticks),
m2 AS (SELECT *, CAST(CASE WHEN d > 0 AND d <= 5 THEN d ELSE 1 END AS DOUBLE) AS dt FROM m1),
m3 AS (SELECT *, CASE WHEN lag(row_in_segment) OVER ({SEG}) IS NULL THEN 0 ELSE (sm - lag(sm) OVER ({SEG})) / 3.6 / dt END AS a0 FROM m2),
m4 AS (SELECT *, avg(a0) OVER ({SEG} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a, sum(CASE WHEN rpm >= 50 THEN greatest(coalesce(maf, 0), 0) * dt ELSE 0 END) OVER ({SEG}) AS air FROM m3),
m5 AS (SELECT *, sm / 3.6 * (1.1 * a + 0.132) + 0.000302 * pow(sm / 3.6, 3) AS vsp FROM m4)"""
_THERMAL = f"""h1 AS (SELECT *, coalesce(sm < 1 AND rpm < 850, FALSE) AS idl, coalesce(sm >= 1 AND air > 1500, FALSE) AS mov, coalesce(intake_temp - ambient_temp > 8, FALSE) AS soak FROM m5),
h2 AS (SELECT *, max(CASE WHEN coalesce(rpm >= 50, FALSE) AND ((coalesce(coolant_temp >= 75, FALSE) AND (idl OR mov OR soak)) OR (coolant_temp IS NULL AND (mov OR soak))) THEN 1 ELSE 0 END) OVER ({SEG}) = 1 AS seen FROM h1),
h3 AS (SELECT *, CASE WHEN rpm IS NULL THEN NULL WHEN rpm < 50 THEN 'engine_off' WHEN seen THEN 'post_warmup' ELSE 'warmup' END AS th0 FROM h2),
h4 AS (SELECT *, coalesce(last_value(th0 IGNORE NULLS) OVER ({SEG}), 'unknown') AS thermal FROM h3),
c1 AS (SELECT *, CASE WHEN speed IS NULL OR rpm IS NULL THEN NULL WHEN thermal = 'engine_off' THEN 'inactive_engine_off' WHEN thermal = 'unknown' THEN 'unknown' WHEN sm < 1 AND abs(a) < 0.15 THEN 'idle'
 WHEN sm >= 1 AND (vsp >= 20 OR a >= 1.2) THEN 'high_load' WHEN sm >= 1 AND a >= 0.15 THEN 'acceleration' WHEN sm >= 1 AND a <= -0.15 THEN 'deceleration' ELSE 'steady_driving' END AS c0 FROM h4),
c2 AS (SELECT *, coalesce(last_value(c0 IGNORE NULLS) OVER ({SEG}), 'unknown') AS child_raw FROM c1)"""


def _conditions(spark, sf_dir):
    return o.child_state(o.thermal_state(o.motion(ticks(spark, sf_dir))))


@query(with_ticks(_MOTION, _THERMAL) + f"SELECT {KEYS}, thermal, child_raw, CASE WHEN thermal = 'engine_off' THEN 'engine_off' WHEN thermal <> 'unknown' AND child_raw <> 'unknown' THEN thermal || '__' || child_raw ELSE 'unknown' END AS operating, round(vsp, 4) AS vsp FROM c2")
def d02_d03_d04_conditions(spark, sf_dir):
    df = _conditions(spark, sf_dir)
    return df.select(*KEY, "thermal", "child_raw", o.operating_state("thermal", "child_raw").alias("operating"), F.round("vsp_kw_per_t", 4).alias("vsp"))


def _smoothing_sql(passes: int) -> str:
    """A pass goes through the runs of a segment one by one, since each sees what the one before has become."""
    free = lambda x: f"CASE WHEN {x} NOT IN ('inactive_engine_off', 'unknown') THEN {x} END"
    new = lambda left: f"CASE WHEN n < 3 AND s NOT IN ('inactive_engine_off', 'unknown') THEN coalesce({free(left)}, {free('nx')}, s) ELSE s END"
    parts = ["sm0 AS (SELECT trip_id, segment_id, row_in_segment, thermal, child_raw AS s FROM c2)"]
    for p in range(passes):
        parts += [
            f"cu{p} AS (SELECT *, CASE WHEN s = lag(s) OVER ({SEG}) THEN 0 ELSE 1 END AS b FROM sm{p})",
            f"gr{p} AS (SELECT *, sum(b) OVER ({SEG}) AS g FROM cu{p})",
            f"ru{p} AS (SELECT *, lead(s) OVER (PARTITION BY trip_id, segment_id ORDER BY g) AS nx FROM (SELECT trip_id, segment_id, g, any_value(s) AS s, count(*) AS n FROM gr{p} GROUP BY ALL))",
            f"fo{p} AS (SELECT *, {new('CAST(NULL AS VARCHAR)')} AS v FROM ru{p} WHERE g = 1 UNION ALL SELECT r.*, {new('v')} FROM (SELECT trip_id, segment_id, g + 1 AS g, v FROM fo{p}) f JOIN ru{p} r USING (trip_id, segment_id, g))",
            f"sm{p + 1} AS (SELECT trip_id, segment_id, row_in_segment, thermal, v AS s FROM gr{p} JOIN (SELECT trip_id, segment_id, g, v FROM fo{p}) USING (trip_id, segment_id, g))",
        ]
    return ",\n".join(parts)


@query(
    with_ticks(_MOTION, _THERMAL, _smoothing_sql(5)).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT trip_id, segment_id, row_in_segment, thermal, CASE WHEN thermal <> 'engine_off' AND s = 'inactive_engine_off' THEN 'unknown' ELSE s END AS child FROM sm5"
)
def w23_smoothed_states(spark, sf_dir):
    return o.smoothed(_conditions(spark, sf_dir))


@query(
    with_ticks(_MOTION, _THERMAL, "u AS (SELECT 'thermal' AS group_type, thermal AS value FROM c2 UNION ALL SELECT 'child_raw', child_raw FROM c2 UNION ALL SELECT 'condition_confidence', condition_confidence FROM c2)")
    + "SELECT group_type, value, rows, round(rows / sum(rows) OVER (PARTITION BY group_type), 9) AS share FROM (SELECT group_type, value, count(*) AS rows FROM u GROUP BY group_type, value)"
)
def a05_state_counts(spark, sf_dir):
    return o.state_counts(_conditions(spark, sf_dir), ("thermal", "child_raw", "condition_confidence")).withColumn("share", F.round("share", 9))


_SIGNALS = ("coolant_temp", "rpm", "maf", "speed")


@query(
    with_ticks("u AS (" + " UNION ALL ".join(f"SELECT child_state AS state, '{s}' AS signal, {s} AS v FROM ticks" for s in _SIGNALS) + ")")
    + "SELECT state, signal, count(v) AS n, count(*) - count(v) AS nulls, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS min, max(v) AS max, "
    + ", ".join(f"round(quantile_cont(v, {q}), 5) AS {n}" for n, q in (("p1", 0.01), ("p5", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    + " FROM u GROUP BY state, signal"
)
def a06_signal_summary(spark, sf_dir):
    df = o.signal_summary(ticks(spark, sf_dir), "child_state", _SIGNALS)
    return df.withColumns({x: F.round(x, 5) for x in ("mean", "std", "p1", "p5", "p50", "p95", "p99")})


@query(
    with_ticks()
    + """SELECT trip_id, count(*) AS rows, count(DISTINCT segment_id) AS segments, count(*) FILTER (maf IS NULL) AS missing_maf, count(*) FILTER (rpm_is_imputed) AS imputed_rpm,
 count(*) FILTER (speed_is_suspicious) AS suspicious_speed, min(t) AS first_t, max(t) AS last_t FROM ticks GROUP BY trip_id"""
)
def a02_a03_a07_cleaning_report(spark, sf_dir):
    return ticks(spark, sf_dir).groupBy("trip_id").agg(
        F.count("*").alias("rows"), F.count_distinct("segment_id").alias("segments"), F.count_if(F.col("maf").isNull()).alias("missing_maf"), F.count_if("rpm_is_imputed").alias("imputed_rpm"),
        F.count_if("speed_is_suspicious").alias("suspicious_speed"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


@query(
    with_ticks("g AS (SELECT avg(rpm) AS m, stddev_samp(rpm) AS s FROM ticks)")
    + "SELECT trip_id, min(rpm) AS lo, max(rpm) AS hi, round(count(*) FILTER (rpm IS NULL) / count(*), 9) AS missing, count(*) FILTER (abs(rpm - m) / s > 2) AS outliers FROM ticks, g GROUP BY trip_id"
)
def a26_a27_quality_matrix(spark, sf_dir):
    df = ticks(spark, sf_dir)
    g = df.agg(F.avg("rpm").alias("m"), F.stddev_samp("rpm").alias("s"))  # one row
    return df.crossJoin(F.broadcast(g)).groupBy("trip_id").agg(
        F.min("rpm").alias("lo"), F.max("rpm").alias("hi"), F.round(F.count_if(F.col("rpm").isNull()) / F.count("*"), 9).alias("missing"), F.count_if(F.abs(F.try_divide(F.col("rpm") - F.col("m"), F.col("s"))) > 2).alias("outliers")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(CASE WHEN d < 0 THEN d + 86400 ELSE d END AS BIGINT) AS seconds, strftime(o_orderdate, '%Y-%m-%d') AS trip_date FROM (SELECT *, (o_orderkey * 7919) % 86400 - (o_custkey * 104729) % 86400 AS d FROM orders)")
def x06_x07_x08_times(spark, sf_dir):
    d = (F.col("o_orderkey") * 7919) % 86400 - (F.col("o_custkey") * 104729) % 86400
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.when(d < 0, d + 86400).otherwise(d).alias("seconds"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("trip_date")
    )
