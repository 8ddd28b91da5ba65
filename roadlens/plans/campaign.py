"""Queries of campaigns and forecast comparison (I-02 to I-09, J-12, A-16, A-17, A-23, M-14) and of audits over groups (A-28 to A-31)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.functions.physics import tidy
from roadlens.operators import campaign as c
from roadlens.operators import features as f
from roadlens.operators import forecasts as fc
from roadlens.operators import rules as r
from roadlens.operators import text_audit as a
from roadlens.operators.continuity import step_of
from roadlens.operators.rolling import tumble_rows
from roadlens.operators.starts import start_episodes
from roadlens.plans.registry import query
from roadlens.plans.rules import DECISIONS, LENGTHS, LIMITS, RULES, samples
from roadlens.plans.sql import SEG, named_blocks, production_sql, tidy_sql, with_ticks
from roadlens.plans.starts import EP
from roadlens.sources.adapters import TICKS_SQL, table, ticks
from roadlens.sources.scratch import written, written_by

#: The pedal channels are driven apart by so many points, for five seconds.
_SEVERITIES = [(f"apart_{x}", 5, {"reference": "accel_pedal_d", "offset": float(x)}) for x in (40, 64, 70)]


def _bare(df):
    """``df`` with its features unknown, for selectors that need none."""
    return df.withColumns({x: F.lit(None).cast("double") for x in f.FEATURES if x != "engine_on_flag"})


def _campaign(spark, sf_dir, rows_a_task=400_000):
    base = ticks(spark, sf_dir).withColumn("operating_state", F.concat_ws("__", "thermal_state", "child_state"))
    parts = max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // rows_a_task + 1)
    base = written_by(f.with_quality(base).repartition(parts, "segment_id"), "campaign", ("segment_id",), parts)
    windows = written(c.select_windows(_bare(base), "pedal_valid", 5), "windows")
    df = c.expand(base, windows, "accel_pedal_e", "relative_offset", _SEVERITIES)
    rules = {"3-S1b": RULES["3-S1b"]}
    state = r.rule_state(f.production(df, **LENGTHS), LIMITS | {"s3s1b_delta": 65.0})
    trips = base.groupBy("trip_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t")).join(windows.select("trip_id"), "trip_id")
    scenarios = F.explode(F.array(*[F.lit(x) for x in ("baseline", *[x[0] for x in _SEVERITIES])]))
    trips = trips.withColumn("scenario", scenarios).select(F.concat("scenario", F.lit("|"), "trip_id").alias("trip_id"), "start_t", "end_t")
    return c.evaluate(r.duration_decisions(r.episodes(state, rules), trips, rules), "3-S1b")


def _campaign_sql() -> str:
    """Each scenario's samples under a trip id of their own, then the decisions as of any other trip; only the check's limit is another."""
    held = "segment_id = w_segment AND row_in_segment BETWEEN first_row AND first_row + 4"
    flags = ("is_imputed", "is_suspicious", "had_hard_invalid_source")
    put = [("baseline", "accel_pedal_e", "FALSE"), *((n, f"accel_pedal_d + {x['offset']}", held) for n, _, x in _SEVERITIES)]
    cells = lambda n, v, h: f"concat('{n}|', trip_id) AS trip_id, CASE WHEN {h} THEN {v} ELSE accel_pedal_e END AS accel_pedal_e, " + ", ".join(f"CASE WHEN {h} THEN FALSE ELSE accel_pedal_e_{x} END AS accel_pedal_e_{x}" for x in flags)
    scenarios = " UNION ALL ".join(f"SELECT * EXCLUDE (w_segment, first_row) REPLACE ({cells(*x)}) FROM bw" for x in put)
    return f"""WITH {TICKS_SQL.replace("ticks AS (", "base AS (")},
bb AS (SELECT *, CASE WHEN t - lag(t) OVER ({SEG}) = 1 AND row_in_segment - lag(row_in_segment) OVER ({SEG}) = 1 THEN 0 ELSE 1 END AS b FROM base), bk AS (SELECT *, sum(b) OVER ({SEG}) AS blk FROM bb),
wi AS (SELECT trip_id, segment_id, min(row_in_segment) AS first_row, min(t) AS ft FROM (SELECT *, row_in_segment - row_number() OVER (PARTITION BY trip_id, segment_id, blk ORDER BY row_in_segment) AS island FROM bk WHERE accel_pedal_d IS NOT NULL AND accel_pedal_e IS NOT NULL)
 GROUP BY trip_id, segment_id, blk, island HAVING count(*) >= 5),
wf AS (SELECT trip_id, segment_id AS w_segment, first_row FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ft, segment_id, first_row) AS k FROM wi) WHERE k = 1),
bw AS (SELECT base.*, w_segment, first_row FROM base JOIN wf USING (trip_id)), ticks AS ({scenarios}),
{DECISIONS.replace("accel_pedal_channel_delta >= 3.0", "accel_pedal_channel_delta >= 65.0")},
sc AS (SELECT split_part(trip_id, '|', 1) AS scenario, split_part(trip_id, '|', 2) AS trip, result_state AS state FROM dec WHERE sub_check_id = '3-S1b'),
rs_ AS (SELECT s.*, b.state AS baseline_state, s.state = 'triggered' AND b.state <> 'triggered' AS detected FROM sc s LEFT JOIN (SELECT trip, state FROM sc WHERE scenario = 'baseline') b USING (trip) WHERE scenario <> 'baseline')"""


@query(_campaign_sql() + " SELECT scenario, trip, state, baseline_state, detected FROM rs_")
def i02_i09_j12_campaign_results(spark, sf_dir):
    return _campaign(spark, sf_dir)


@query(
    _campaign_sql()
    + """, cv AS (SELECT scenario, CAST(split_part(scenario, '_', 2) AS INTEGER) AS severity, count(*) AS trips, count(*) FILTER (detected) AS detected FROM rs_ WHERE baseline_state <> 'triggered' GROUP BY ALL),
cz AS (SELECT *, detected / trips AS rate, 1.959963984540054 AS z FROM cv)
SELECT scenario, trips, detected, row_number() OVER (ORDER BY severity) AS rank, rate, greatest((rate + z * z / (2 * trips) - z * sqrt(rate * (1 - rate) / trips + z * z / (4 * trips * trips))) / (1 + z * z / trips), 0) AS lo,
 least((rate + z * z / (2 * trips) + z * sqrt(rate * (1 - rate) / trips + z * z / (4 * trips * trips))) / (1 + z * z / trips), 1) AS hi, coalesce(rate >= lag(rate) OVER (ORDER BY severity), TRUE) AS not_falling, rate >= 0.8 AND trips >= 1 AS accepted FROM cz"""
)
def a23_detection_curve(spark, sf_dir):
    return c.curve(_campaign(spark, sf_dir), [x[0] for x in _SEVERITIES], 0.8, 1)


@query(
    with_ticks(
        "cand AS (SELECT *, rpm >= 500 AS h, row_in_segment - row_number() OVER (PARTITION BY trip_id, segment_id, coalesce(rpm >= 500, FALSE) ORDER BY row_in_segment) AS isl FROM ticks)",
        f"br AS (SELECT *, CASE WHEN t - lag(t) OVER ({SEG}) = 1 AND row_in_segment - lag(row_in_segment) OVER ({SEG}) = 1 THEN 0 ELSE 1 END AS b FROM ticks)",
        f"bl AS (SELECT *, sum(b) OVER ({SEG}) AS blk FROM br)",
        "hh AS (SELECT *, row_in_segment - row_number() OVER (PARTITION BY trip_id, segment_id, blk ORDER BY row_in_segment) AS isl FROM bl WHERE rpm >= 500)",
        "gg AS (SELECT trip_id, segment_id, blk, isl, min(row_in_segment) AS first_row, min(t) AS ft, count(*) AS n FROM hh GROUP BY ALL)",
    )
    + "SELECT trip_id, segment_id, first_row FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ft, segment_id) AS k FROM gg WHERE n >= 30) WHERE k = 1"
)
def i02_select_windows(spark, sf_dir):
    return c.select_windows(_bare(ticks(spark, sf_dir).withColumn("operating_state", F.concat_ws("__", "thermal_state", "child_state"))), "engine_firing", 30)


_SECONDS = {"post_warmup": 20, "post_warmup_high_load": 3, "steady_driving": 2, "engine_firing": 30, "pedal_lowmotion": 6, "iat_context_change": 4, "map_context_change": 4, "cold_start_ect": 1, "cold_start_iat": 1}


def _all_selectors_sql() -> str:
    soaked = "row_in_segment = 1 AND gap >= 60 AND rpm < 50 AND later_start AND coolant_temp IS NOT NULL AND intake_temp IS NOT NULL AND ambient_temp IS NOT NULL"
    where = {
        "post_warmup": "thermal_state = 'post_warmup' AND ambient_temp <= 25", "post_warmup_high_load": "operating_state = 'post_warmup__high_load'",
        "steady_driving": "operating_state = 'post_warmup__steady_driving' AND pedal_slope = 0 AND abs(rpm_slope) <= 2000", "engine_firing": "rpm >= 500", "pedal_lowmotion": "rpm >= 50 AND abs(pedal_slope) <= 2.4 AND pedal_mapping_residual IS NOT NULL",
        "iat_context_change": "rpm >= 50 AND (coalesce(speed_std >= 12.4, FALSE) OR coalesce(maf_std >= 8.5, FALSE)) AND intake_temp_stability IS NOT NULL",
        "map_context_change": "rpm >= 50 AND (coalesce(rpm_std >= 241, FALSE) OR coalesce(speed_std >= 12.4, FALSE) OR coalesce(accel_pedal_mean_std >= 9.9, FALSE)) AND map_range IS NOT NULL",
        "cold_start_ect": f"{soaked} AND abs(intake_temp - ambient_temp) <= 7", "cold_start_iat": f"{soaked} AND abs(coolant_temp - ambient_temp) <= 100",
    }
    rows = " UNION ALL ".join(f"SELECT '{n}' AS selector, {_SECONDS[n]} AS need, trip_id, segment_id, row_in_segment, t, block FROM sel WHERE {w}" for n, w in where.items())
    return f"""{named_blocks({"block": "TRUE"}, "prod", "sl0")},
ls AS (SELECT trip_id, segment_id, count(*) > 0 AS later_start FROM ept GROUP BY ALL),
sel AS (SELECT sl0.*, gap, coalesce(later_start, FALSE) AS later_start FROM sl0 LEFT JOIN ls USING (trip_id, segment_id) JOIN (SELECT trip_id, segment_id, CASE WHEN a - lag(z) OVER (ORDER BY a, trip_id, segment_id) >= 0 THEN a - lag(z) OVER (ORDER BY a, trip_id, segment_id) END AS gap FROM (SELECT trip_id, segment_id, min(t) AS a, max(t) AS z FROM ticks GROUP BY ALL)) g USING (trip_id, segment_id)),
lo AS ({rows}), isl AS (SELECT *, row_in_segment - row_number() OVER (PARTITION BY selector, trip_id, segment_id, block ORDER BY row_in_segment) AS island FROM lo),
fi AS (SELECT selector, trip_id, segment_id, min(row_in_segment) AS first_row, min(t) AS first_t FROM isl GROUP BY selector, need, trip_id, segment_id, block, island HAVING count(*) >= need),
fo AS (SELECT *, row_number() OVER (PARTITION BY selector, trip_id ORDER BY first_t, segment_id, first_row) AS o FROM fi)"""


@query(with_ticks(production_sql(**LENGTHS), EP, _all_selectors_sql()) + "SELECT selector, trip_id, segment_id, first_row, first_t FROM fo WHERE o = 1")
def i02_i08_all_selectors(spark, sf_dir):
    """The windows of all nine selectors from one pass over samples with features."""
    df = samples(spark, sf_dir)
    starts = start_episodes(df).select("trip_id", "segment_id").distinct().withColumn("later_start", F.lit(True))
    gaps = step_of(df).select("trip_id", "segment_id", F.col("gap_seconds").alias("segment_gap_seconds"))
    df = df.join(gaps, ["trip_id", "segment_id"]).join(starts, ["trip_id", "segment_id"], "left").withColumn("later_start", F.coalesce("later_start", F.lit(False)))
    return c.all_windows(df, _SECONDS, {"soak_gap_s": 60.0, "ect_witness": 100.0, "s5s2_rpm_slope": 2000.0})


_HIT = "row_in_segment BETWEEN 70 AND 75 OR row_in_segment BETWEEN 120 AND 121"


def _recomputed_sql(span: int, long: int, short: int) -> str:
    w = lambda n: f"(PARTITION BY trip_id, segment_id ORDER BY row_in_segment ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    full = lambda n, x, v: f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {v} END"
    std = lambda n, x: full(n, x, f"stddev_samp({x}) OVER {w(n)}")
    load = "least(greatest(map * rpm / (intake_temp + 273.15), 293.93209175000004), 1516.36693525)"
    return f"""ij AS (SELECT trip_id, segment_id, row_in_segment, rpm, speed, ambient_temp, accel_pedal_d, map, CASE WHEN {_HIT} THEN coolant_temp + 15 ELSE coolant_temp END AS coolant_temp, CASE WHEN {_HIT} THEN intake_temp + 4 ELSE intake_temp END AS intake_temp,
 CASE WHEN {_HIT} THEN maf * 0.7 ELSE maf END AS maf, CASE WHEN {_HIT} THEN accel_pedal_d + 20 ELSE accel_pedal_e END AS accel_pedal_e FROM ticks),
ia AS (SELECT *, coolant_temp - ambient_temp AS coolant_ambient_delta, intake_temp - ambient_temp AS intake_ambient_delta, (accel_pedal_d + accel_pedal_e) / 2 AS accel_pedal_mean, abs(accel_pedal_d - accel_pedal_e) AS accel_pedal_channel_delta, accel_pedal_e - (0.997273 * accel_pedal_d + 0.383103) AS pedal_mapping_residual,
 CASE WHEN map IS NOT NULL AND rpm IS NOT NULL AND intake_temp IS NOT NULL THEN maf - (-14.688826051927967 + 0.023778032668470294 * {load} + 0.14127609145896305 * least(greatest(map, 94.0), 203.0) + 6.690047685838753e-05 * least(greatest(rpm, 877.0), 2205.0) + 0.07101467711912292 * least(greatest(intake_temp, -8.0), 40.0)) END AS speed_density_maf_residual FROM ij),
ic AS (SELECT trip_id, segment_id, row_in_segment, coolant_ambient_delta, intake_ambient_delta, accel_pedal_mean, accel_pedal_channel_delta, pedal_mapping_residual, speed_density_maf_residual, accel_pedal_mean - lag(accel_pedal_mean) OVER s AS pedal_slope, rpm - lag(rpm) OVER s AS rpm_slope,
 (coolant_temp - lag(coolant_temp, {span}) OVER s) / ({span} / 60) AS ect_rate, {std(short, "intake_temp")} AS intake_temp_stability, {std(long, "speed")} AS speed_std, {std(long, "maf")} AS maf_std, {std(long, "rpm")} AS rpm_std, {std(long, "accel_pedal_mean")} AS accel_pedal_mean_std,
 {full(short, "map", f"max(map) OVER {w(short)} - min(map) OVER {w(short)}")} AS map_range, {full(span + 1, "maf", f"sum(maf) OVER {w(span + 1)} - (maf + lag(maf, {span}) OVER s) / 2")} AS maf_integral FROM ia WINDOW s AS (PARTITION BY trip_id, segment_id ORDER BY row_in_segment))"""


@query(with_ticks(_recomputed_sql(18, 12, 6)) + "SELECT trip_id, segment_id, row_in_segment, " + ", ".join(f"{tidy_sql(x, 4)} AS {x}" for x in c.RECOMPUTED) + " FROM ic")
def i06_recomputed_features(spark, sf_dir, rows_a_task: int = 400_000):
    """Features after two faults in each segment, worked out anew about the changed rows only; the oracle works out all of them."""
    keys, segment = ["trip_id", "segment_id", "row_in_segment"], ("trip_id", "segment_id")
    parts = max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // rows_a_task + 1)
    df = ticks(spark, sf_dir).select(*keys, "rpm", "speed", "ambient_temp", "accel_pedal_d", "map", "coolant_temp", "intake_temp", "maf", "accel_pedal_e")
    before = written_by(c.recomputed(df.repartition(parts, *segment), **LENGTHS), "features", segment, parts)
    changed = before.where(_HIT).select(*keys, (F.col("coolant_temp") + 15).alias("coolant_temp"), (F.col("intake_temp") + 4).alias("intake_temp"), (F.col("maf") * 0.7).alias("maf"), (F.col("accel_pedal_d") + 20).alias("accel_pedal_e"))
    out = c.recomputed_about(before, changed, **LENGTHS)
    return out.select(*keys, *[tidy(F.col(x), 4).alias(x) for x in c.RECOMPUTED])


_S = ("rpm", "coolant_temp", "map", "maf")
_FC = f"""wn AS (SELECT *, CAST(floor((row_number() OVER ({SEG}) - 1) / 60) AS INTEGER) AS window_no FROM ticks),
wk AS (SELECT *, count(*) OVER (PARTITION BY trip_id, segment_id, window_no) AS k FROM wn),
fw AS (SELECT *, {", ".join(f"first_value({s}) OVER w AS {s}_a, lag({s}) OVER w AS {s}_b" for s in _S)} FROM wk WHERE k = 60 WINDOW w AS (PARTITION BY trip_id, segment_id, window_no ORDER BY row_in_segment))"""


def _forecasts(spark, sf_dir):
    w = Window.partitionBy("trip_id", "segment_id", "window_no").orderBy("row_in_segment")
    df = tumble_rows(ticks(spark, sf_dir), 60)
    return df.withColumns({f"{s}_a": F.first(s).over(w) for s in _S} | {f"{s}_b": F.lag(s).over(w) for s in _S})


def _mae_sql(x: str) -> str:
    return f"m{x} AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, avg(abs({s}_{x} - {s})) AS mae, count(abs({s}_{x} - {s})) AS points FROM fw" for s in _S) + ")"


@query(with_ticks(_FC, _mae_sql("a")) + "SELECT signal, round(mae, 6) AS mae, points FROM ma")
def a16_forecast_mae(spark, sf_dir):
    return fc.mae(_forecasts(spark, sf_dir), _S, "_a").withColumn("mae", F.round("mae", 6))


@query(
    with_ticks(_FC, _mae_sql("a"), _mae_sql("b"), "j AS (SELECT ma.signal, ma.mae AS before, mb.mae AS after, ma.points AS n FROM ma JOIN mb ON ma.signal = mb.signal)")
    + """SELECT signal, round(before, 6) AS before, round(after, 6) AS after, round((before - after) / before * 100, 5) AS improvement_pct,
 (SELECT (sum(before * n) - sum(after * n)) / sum(before * n) * 100 >= 5 AND count(*) FILTER (before >= after) >= 4 FROM j) AS clear_improvement FROM j"""
)
def m14_compare_forecasts(spark, sf_dir):
    df = _forecasts(spark, sf_dir)
    out = fc.compare(fc.mae(df, _S, "_a"), fc.mae(df, _S, "_b"))
    return out.withColumns({"before": F.round("before", 6), "after": F.round("after", 6), "improvement_pct": F.round("improvement_pct", 5)})


def _corr_sql(x: str, y: str, known: str) -> str:
    spread = f"stddev_pop({x}) FILTER ({known}) * stddev_pop({y}) FILTER ({known})"
    return f"CASE WHEN {spread} > 1e-12 THEN covar_pop({x}, {y}) FILTER ({known}) / ({spread}) END"


_PAIRS = [(x, y) for i, x in enumerate(_S) for y in _S[i + 1 :]]
_CORR = "cw AS (SELECT " + ", ".join(
    f"abs({_corr_sql(f'{x}_b', f'{y}_b', f'{x} IS NOT NULL AND {y} IS NOT NULL AND {x}_b IS NOT NULL AND {y}_b IS NOT NULL')} - {_corr_sql(x, y, f'{x} IS NOT NULL AND {y} IS NOT NULL')}) AS e{i}" for i, (x, y) in enumerate(_PAIRS)
) + " FROM fw GROUP BY trip_id, segment_id, window_no)"


@query(with_ticks(_FC, _CORR, "ce AS (" + " UNION ALL ".join(f"SELECT e{i} AS e FROM cw" for i in range(len(_PAIRS))) + ")") + "SELECT count(e) AS pairs, round(avg(e), 6) AS error FROM ce")
def a17_correlation_error(spark, sf_dir):
    return fc.correlation_error(_forecasts(spark, sf_dir), _S, "_b", ("trip_id", "segment_id", "window_no")).withColumn("error", F.round("error", 6))


@query(
    """SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (o_totalprice > 200000) AS triggered, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus"""
)
def a28_a29_audit(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("rows"), F.count_if(F.col("o_totalprice") > 200000).alias("triggered"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities")
    )


@query(
    """WITH s AS (SELECT conv_id AS report, CASE turn % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'synonym' ELSE 'punctuation' END AS variant, role AS dimension, max(length(text) % 4) AS score FROM conversations GROUP BY ALL),
o AS (SELECT report, dimension, max(score) FILTER (variant = 'original') AS original FROM s GROUP BY ALL)
SELECT variant, round(avg(CAST(score = original AS INTEGER)), 6) AS unchanged, count(*) AS n FROM s JOIN o USING (report, dimension) WHERE variant <> 'original' GROUP BY variant"""
)
def a30_a31_stability(spark, sf_dir):
    k = F.col("turn") % 3
    variant = F.when(k == 0, "original").when(k == 1, "synonym").otherwise("punctuation")
    s = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("report"), variant.alias("variant"), F.col("role").alias("dimension")).agg(F.max(F.length("text") % 4).alias("score"))
    return a.stability(s).withColumn("unchanged", F.round("unchanged", 6))


