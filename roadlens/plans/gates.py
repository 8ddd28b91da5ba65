"""Queries of contract checks, joins, sets and lineage (V-*, J-*, U-*, S-08 to S-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.functions.physics import parse_bool
from roadlens.operators import gates as g
from roadlens.operators import scoring
from roadlens.operators.continuity import segment_window
from roadlens.plans.registry import query
from roadlens.plans.sql import SEG, with_ticks
from roadlens.sources import sinks
from roadlens.sources.adapters import table, ticks
from roadlens.sources.scratch import scratch

_RULES = {
    "dt_is_one": ("t - lag(t) OVER s = 1 OR lag(t) OVER s IS NULL", lambda: (F.col("t") - F.lag("t").over(segment_window()) == 1) | F.lag("t").over(segment_window()).isNull()),
    "known_state": ("child_state IN ('idle', 'steady_driving', 'acceleration', 'deceleration', 'high_load', 'inactive_engine_off')", lambda: F.col("child_state").isin("idle", "steady_driving", "acceleration", "deceleration", "high_load", "inactive_engine_off")),
    "maf_not_null": ("maf IS NOT NULL", lambda: F.col("maf").isNotNull()),
    "rows_from_one": ("row_in_segment >= 1", lambda: F.col("row_in_segment") >= 1),
    "segment_of_trip": ("starts_with(segment_id, trip_id)", lambda: F.startswith("segment_id", "trip_id")),
}


@query(
    with_ticks("c AS (SELECT " + ", ".join(f"coalesce({s}, FALSE) AS {n}" for n, (s, _) in _RULES.items()) + f" FROM ticks WINDOW s AS ({SEG}))", "a AS (SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER (NOT {n}) AS {n}" for n in _RULES) + " FROM c)")
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, rows, {n} AS broken FROM a" for n in _RULES)
)
def v02_v05_v09_violations(spark, sf_dir):
    df = ticks(spark, sf_dir)
    df = df.select(*[F.coalesce(c(), F.lit(False)).alias(n) for n, (_, c) in _RULES.items()])
    return g.violations(df, {n: F.col(n) for n in _RULES})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def v07_duplicate_keys(spark, sf_dir):
    return g.duplicate_keys(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query(
    "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL"
)
def v08_u02_j02_key_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).alias("m"))
    return g.key_differences(o.where("m = 0").select("k").distinct(), o.where("m = 1").select("k").distinct(), ("k",))


@query(
    """SELECT doc_id, try_strptime(d, '%Y-%m-%d') IS NOT NULL AS iso, TRY_CAST(n AS DOUBLE) IS NULL AS not_a_number, CASE WHEN b IN ('true', '1', 'yes') THEN TRUE WHEN b IN ('false', '0', 'no') THEN FALSE END AS flag
FROM (SELECT doc_id, '2020-' || CASE WHEN doc_id % 3 = 0 THEN '02' ELSE '01' END || '-' || lpad(CAST(doc_id % 35 AS VARCHAR), 2, '0') AS d, CASE WHEN doc_id % 5 = 0 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS n, (['true', '1', 'Yes ', 'false', '0', 'no', 'maybe'])[1 + doc_id % 7] AS b0, lower(trim(b0)) AS b FROM documents)"""
)
def v03_v04_x10_coercion(spark, sf_dir):
    k = F.col("doc_id")
    date = F.concat(F.when(k % 3 == 0, "2020-02-").otherwise("2020-01-"), F.lpad((k % 35).cast("string"), 2, "0"))
    number = F.when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    text = F.element_at(F.array(*[F.lit(x) for x in ("true", "1", "Yes ", "false", "0", "no", "maybe")]), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.try_to_date(date).isNotNull().alias("iso"), number.try_cast("double").isNull().alias("not_a_number"), parse_bool(text).alias("flag"))


@query(
    with_ticks("f AS (SELECT trip_id AS file, count(*) AS rows, min(t) % 86400 AS a, max(t) % 86400 AS b, count(*) FILTER (maf IS NULL) AS m FROM ticks GROUP BY trip_id)", "d AS (SELECT *, CASE WHEN b < a THEN b - a + 86400 ELSE b - a END AS s FROM f)")
    + "SELECT file, rows, CAST(s AS BIGINT) AS seconds, CASE WHEN m > 12 THEN 'missing_values' WHEN rows < 600 THEN 'too_few_rows' WHEN s < 610 THEN 'too_short' ELSE 'ok' END AS code FROM d"
)
def v11_x07_intake(spark, sf_dir):
    f = ticks(spark, sf_dir).groupBy(F.col("trip_id").alias("file")).agg(
        F.count("*").alias("rows"), (F.min("t") % 86400).alias("first_second"), (F.max("t") % 86400).alias("last_second"), F.greatest(F.count_if(F.col("maf").isNull()) - 12, F.lit(0)).alias("missing")
    )
    return g.intake(f, 600, 610)


@query(with_ticks("s AS (SELECT trip_id, segment_id, count(*) AS n FROM ticks GROUP BY ALL)") + "SELECT trip_id, max(n) AS longest, count(*) AS segments, max(n) >= 400 AS usable FROM s GROUP BY trip_id")
def v12_a12_p11_usable_segment(spark, sf_dir):
    n = ticks(spark, sf_dir).groupBy("trip_id", "segment_id").agg(F.count("*").alias("n"))
    return n.groupBy("trip_id").agg(F.max("n").alias("longest"), F.count("*").alias("segments"), (F.max("n") >= 400).alias("usable"))


_RANGE = {"coolant_temp": (-40.0, 105.0), "maf": (0.0, 60.0)}


@query(
    with_ticks(
        "w AS (SELECT *, coalesce(coolant_temp NOT BETWEEN -40 AND 105, FALSE) AS b1, coalesce(maf NOT BETWEEN 0 AND 60, FALSE) AS b2 FROM ticks)",
        "s AS (SELECT trip_id, segment_id, avg(CAST(b1 AS INTEGER)) > 0.05 OR count(coolant_temp) FILTER (NOT b1) = 0 AS r1, avg(CAST(b2 AS INTEGER)) > 0.05 OR count(maf) FILTER (NOT b2) = 0 AS r2 FROM w GROUP BY ALL)",
    )
    + "SELECT trip_id, segment_id, row_in_segment, CASE WHEN NOT b1 THEN coolant_temp END AS coolant_temp, CASE WHEN NOT b2 THEN maf END AS maf, concat_ws(',', CASE WHEN r1 THEN 'coolant_temp' END, CASE WHEN r2 THEN 'maf' END) AS rejected FROM w JOIN s USING (trip_id, segment_id)"
)
def v14_plausible(spark, sf_dir):
    df = ticks(spark, sf_dir).select("trip_id", "segment_id", "row_in_segment", "coolant_temp", "maf")
    return g.plausible(df, _RANGE, ("trip_id", "segment_id"))


@query(
    """WITH h AS (SELECT user_id, event_id, value, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events)
SELECT user_id, count(*) AS rows, count(*) FILTER (value IS NULL OR value < 0 OR value > 100) AS out_of_range, count(*) FILTER (back) AS out_of_order FROM h GROUP BY user_id"""
)
def v16_history_gate(spark, sf_dir):
    from pyspark.sql import Window

    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    v = F.col("value")
    return table(spark, sf_dir, "events").withColumn("back", back).groupBy("user_id").agg(
        F.count("*").alias("rows"), F.count_if(v.isNull() | (v < 0) | (v > 100)).alias("out_of_range"), F.count_if(F.coalesce("back", F.lit(False))).alias("out_of_order")
    )


@query(
    "WITH h AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey)), 1, 15)) AS BIGINT) AS h0, CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey)), 17, 15)) AS BIGINT) AS h1 FROM orders)"
    " SELECT count(*) AS rows, CAST(sum(h0) AS VARCHAR) AS sum0, CAST(sum(h1) AS VARCHAR) AS sum1, bit_xor(h0) AS xor0, bit_xor(h1) AS xor1 FROM h"
)
def s10_key_fingerprint(spark, sf_dir):
    return g.fingerprint(table(spark, sf_dir, "orders"), ("o_orderkey", "o_custkey"))


@query(
    "WITH a AS (SELECT count(*) AS rows, count(*) FILTER (value IS NULL) AS value, count(*) FILTER (ts IS NULL) AS ts, count(*) FILTER (props IS NULL) AS props, count(*) FILTER (event_id IS NULL) AS event_id, count(*) FILTER (user_id IS NULL) AS user_id, count(*) FILTER (event_type IS NULL) AS event_type FROM events) "
    + " UNION ALL ".join(f"SELECT 'events' AS stage, '{c}' AS column, '{t}' AS type, rows, {c} AS nulls FROM a" for c, t in (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")))
)
def s08_run_manifest(spark, sf_dir):
    return g.run_manifest("events", table(spark, sf_dir, "events"))


_IDENTIFIED = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")}
_hash = lambda c, at: f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(c)})), {at}, 15)) AS BIGINT)"


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, CAST(sum({_hash(c, 1)}) AS VARCHAR) AS sum0, CAST(sum({_hash(c, 17)}) AS VARCHAR) AS sum1, bit_xor({_hash(c, 1)}) AS xor0, bit_xor({_hash(c, 17)}) AS xor1 FROM {t}" for t, c in _IDENTIFIED.items())
)
def s09_dataset_identity(spark, sf_dir):
    return g.dataset_identity({t: table(spark, sf_dir, t).select(*c) for t, c in _IDENTIFIED.items()})


@query("SELECT * FROM (VALUES ('region', 'ok'), ('nation', 'unrecorded'), ('orders', 'changed'), ('customer', 'missing')) AS v(\"table\", verdict)")
def s11_verify_identity(spark, sf_dir):
    """A record that lacks a table, names one that is not there, and was made before an order changed its status."""
    now = {t: table(spark, sf_dir, t).select(*c) for t, c in _IDENTIFIED.items()}
    status = F.when(F.col("o_orderkey") == 1, "?").otherwise(F.col("o_orderstatus"))
    before = {"region": now["region"], "orders": now["orders"].withColumn("o_orderstatus", status), "customer": table(spark, sf_dir, "customer").select("c_custkey")}
    return g.verify(g.dataset_identity(now), g.dataset_identity(before))


@query(
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"event_type\":\"' || event_type || '\",\"k\":' || json_extract(props, '$.k') || '}' AS record FROM events"
)
def s12_x23_x24_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct("event_type", "p.k")).alias("record"))


@query("WITH n AS (SELECT event_id % 700 AS window_id, printf('trip_%04d', user_id) AS trip_id FROM events WHERE event_id % 2 = 0), h AS (SELECT event_id % 700 AS window_id, printf('trip_%04d', user_id) AS trip_id FROM events WHERE event_id % 5 = 0) SELECT DISTINCT trip_id, window_id FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.trip_id = n.trip_id AND h.window_id = n.window_id)")
def s13_append_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 700).alias("window_id"), F.format_string("trip_%04d", "user_id").alias("trip_id"))
    return scoring.append_history(e.where("event_id % 2 = 0"), e.where("event_id % 5 = 0")).select("trip_id", "window_id")


@query("SELECT o_orderkey, c_name, coalesce(n, 0) AS matches FROM orders LEFT JOIN (SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n FROM customer GROUP BY c_custkey) c ON o_custkey = c_custkey")
def j01_join_one_to_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return g.join_one_to_one(o, c, ("c_custkey",)).select("o_orderkey", "c_name", "matches")


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type FROM events),
j AS (SELECT l.user_id, l.event_id AS id, l.t, r.t AS r_t, abs(l.t - r.t) AS d, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.t) AS k FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'click' AND abs(l.t - r.t) <= 21600000000)
SELECT l.user_id, l.event_id AS id, l.t, j.r_t, j.d AS distance FROM e l LEFT JOIN j ON j.id = l.event_id AND j.k = 1 WHERE l.event_type = 'purchase'"""
)
def j05_asof_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)"))
    left = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), "t")
    right = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("r_id"), F.col("t").alias("r_t"))
    return g.asof_nearest(left, right, "user_id", 21_600_000_000)


@query(
    """SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders, bool_or(o_orderpriority = '1-URGENT') AS urgent, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS best_f
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"""
)
def j03_j09_j10_j11_witness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("best_f")
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", F.coalesce("orders", F.lit(0)).alias("orders"), "urgent", "best_f")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50) GROUP BY event_type")
def p10_j11_j16_a32_semi_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keep = e.where("event_type = 'error' and value > 50").select("user_id").distinct()
    return e.join(keep, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k <= 3")
def t03_t07_t11_first_n(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id", "value")


@query(
    with_ticks("f AS (SELECT trip_id, segment_id, min(row_in_segment) AS r FROM ticks WHERE thermal_state = 'post_warmup' GROUP BY ALL)") + "SELECT trip_id, segment_id, row_in_segment, thermal_state FROM ticks JOIN f USING (trip_id, segment_id) WHERE row_in_segment >= r"
)
def p12_trim_from_first(spark, sf_dir):
    from pyspark.sql import Window

    first = F.min(F.when(F.col("thermal_state") == "post_warmup", F.col("row_in_segment"))).over(Window.partitionBy("trip_id", "segment_id"))
    return ticks(spark, sf_dir).withColumn("first", first).where("row_in_segment >= first").select("trip_id", "segment_id", "row_in_segment", "thermal_state")


@query(with_ticks() + "SELECT trip_id, child_state, count(*) AS n, round(count(*) / (SELECT count(*) FROM ticks t2 WHERE t2.trip_id = ticks.trip_id), 9) AS share FROM ticks GROUP BY trip_id, child_state")
def a25_state_share(spark, sf_dir):
    from pyspark.sql import Window

    n = ticks(spark, sf_dir).groupBy("trip_id", "child_state").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("trip_id")), 9))


@query("SELECT o_orderstatus, count(*) AS rows, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def s07_atomic_replace(spark, sf_dir):
    """A table of orders is published, replaced by its even ones, and replaced again by a job that fails half way: readers see the second version."""
    path, df = scratch(spark, "published"), table(spark, sf_dir, "orders")
    sinks.publish(df, path)
    sinks.publish(df.where("o_orderkey % 2 = 0"), path, by=("o_orderstatus",))
    spoilt = F.when(F.col("o_orderkey") % 3 == 1, F.raise_error(F.lit("the writer fails"))).otherwise(F.col("o_totalprice"))
    try:
        sinks.publish(df.withColumn("o_totalprice", spoilt), path)
    except Exception as failure:  # noqa: BLE001 - what Spark raises differs by version; any other failure is raised again
        if "the writer fails" not in str(failure):
            raise
    out = sinks.read_published(spark, path)
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query("SELECT CAST(o_orderpriority AS VARCHAR) AS o_orderpriority, count(*) AS rows, min(o_orderkey) AS least FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1")
def s04_s06_partitioned_table(spark, sf_dir):
    """A table partitioned by a key, read back for two of its values: only their folders are listed and two columns read."""
    path = scratch(spark, "partitioned")
    sinks.write_table(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice"), path, by=("o_orderpriority",))
    out = spark.read.parquet(path).where(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"))
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("least"))
