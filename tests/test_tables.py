"""Published tables, the contract of the production table, campaign windows, recomputed features and whole histories."""

import random

import pytest
from pyspark.sql import functions as F

from roadlens.operators import assembly, campaign, records
from roadlens.sources import sinks
from roadlens.sources.scratch import written_by


def test_publish_replaces_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, path)
    assert sinks.current(spark, path) is None
    sinks.publish(spark.range(5).toDF("x"), path)
    old = sinks.read_published(spark, path)
    sinks.publish(spark.range(3).select(F.col("id").alias("x"), (F.col("id") % 2).alias("p")), path, by=("p",))
    assert sinks.read_published(spark, path).count() == 3 and old.count() == 5  # a reader of the old version goes on
    with pytest.raises(Exception, match="half way"):
        sinks.publish(spark.range(100).select(F.when(F.col("id") > 50, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).alias("x")), path)
    assert sinks.read_published(spark, path).count() == 3
    assert sinks.vacuum(spark, path) == 2 and sinks.read_published(spark, path).count() == 3 and sinks.vacuum(spark, path) == 0


def good(spark):
    kinds = {f.name: f.kind for f in assembly.CONTRACT}
    row = {f.name: None for f in assembly.CONTRACT} | dict(
        timestamp=1, trip_id="t", segment_id="s", row_in_segment=1, dt_seconds=1.0, thermal_state="warmup", child_state="idle", operating_state="warmup__idle", condition_confidence="high", condition_quality_flags="OK",
        engine_start_observed=False, schema_version="feature_schema.v1", calibration_version="calibration.v1",
    )
    return spark.createDataFrame([tuple(row.values()), tuple((row | {"row_in_segment": 2, "speed": 3.0}).values())], ", ".join(f"{n} {k}" for n, k in kinds.items()))


def faults(df):
    return {(r["rule"], r["column"]): r["faults"] for r in assembly.contract_faults(df).collect()}


def test_contract(spark):
    df = good(spark)
    assert len(assembly.CONTRACT) == 46 and faults(df) == {}
    assert faults(df.select([F.col(c).cast("string").alias(c) for c in df.columns])) == {}  # text that parses is sound
    assert faults(df.limit(0)) == {}
    assert faults(df.unionByName(df)) == {("key_twice", "trip_id,segment_id,row_in_segment"): 4}
    assert faults(df.withColumn("row_in_segment", F.lit("2.5"))) == {("type", "row_in_segment"): 2, ("key_twice", "trip_id,segment_id,row_in_segment"): 2}
    assert faults(df.withColumn("rpm", F.lit("fast"))) == {("type", "rpm"): 2}
    assert faults(df.withColumn("rpm", F.lit(1))) == {("type", "rpm"): 1}
    assert faults(df.withColumn("child_state", F.lit("asleep"))) == {("domain", "child_state"): 2}
    assert faults(df.withColumn("child_state", F.lit(None).cast("string"))) == {("null", "child_state"): 2}
    assert faults(df.withColumn("dt_seconds", F.lit(0.5))) == {("constant", "dt_seconds"): 2}
    assert faults(df.withColumn("schema_version", F.lit(None).cast("string"))) == {("null", "schema_version"): 2, ("constant", "schema_version"): 2}
    names = df.columns
    assert faults(df.select("trip_id", *[c for c in names if c != "trip_id"])) == {("order", "trip_id"): 1}
    assert faults(df.drop("map").withColumn("more", F.lit(1))) == {("missing", "map"): 1, ("unexpected", "more"): 1}


SIGNALS = ("rpm", "speed", "ambient_temp", "accel_pedal_d", "map", "coolant_temp", "intake_temp", "maf", "accel_pedal_e")


@pytest.mark.parametrize("seed", [1, 2])
def test_recomputation_about_changes_equals_all_of_it(spark, seed):
    rng = random.Random(seed)
    rows = [("t", f"s{s}", i + (i > 40), *[None if rng.random() < 0.02 else rng.uniform(1, 90) for _ in SIGNALS]) for s in range(4) for i in range(1, 90)]
    schema = "trip_id string, segment_id string, row_in_segment int, " + ", ".join(f"{s} double" for s in SIGNALS)
    df, lengths = spark.createDataFrame(rows, schema), {"span": 9, "long": 6, "short": 4}
    hit = {(s, r) for s, r in ((f"s{rng.randrange(3)}", rng.choice([1, 2, 5, 30, 39, 42, 80, 90])) for _ in range(9))}
    changed = spark.createDataFrame([("t", s, r, rng.uniform(1, 90), None) for s, r in hit], "trip_id string, segment_id string, row_in_segment int, maf double, map double")
    changed = changed.join(df.select("trip_id", "segment_id", "row_in_segment"), ["trip_id", "segment_id", "row_in_segment"])
    got = campaign.recomputed_about(campaign.recomputed(df, **lengths), changed, **lengths)
    keys = ["trip_id", "segment_id", "row_in_segment"]
    whole = df.join(changed.select(*keys, F.col("maf").alias("m1"), F.lit(True).alias("hit")), keys, "left")
    whole = campaign.recomputed(whole.withColumns({"maf": F.when(F.col("hit"), F.col("m1")).otherwise(F.col("maf")), "map": F.when(F.col("hit"), F.lit(None)).otherwise(F.col("map"))}).drop("m1", "hit"), **lengths)
    tell = lambda d: {tuple(r[k] for k in keys): [None if r[c] is None else round(r[c], 6) for c in (*SIGNALS, *campaign.RECOMPUTED)] for r in d.collect()}
    a, b = tell(got), tell(whole)
    assert a == b and len(a) == len(rows) and any(x[-1] is not None for x in a.values())


def test_recomputation_asks_for_a_temperature_above_absolute_zero(spark):
    schema = "trip_id string, segment_id string, row_in_segment int, " + ", ".join(f"{s} double" for s in SIGNALS)
    row = ("t", "s", 1, *[1.0] * 6, -273.15, 1.0, 1.0)
    with pytest.raises(Exception, match="absolute zero"):
        campaign.recomputed(spark.createDataFrame([row], schema)).select("speed_density_maf_residual").collect()


def test_all_windows_take_the_first_long_enough_run_of_a_trip(spark):
    rows = []
    for trip, segment, begin, rpm in (("a", "s1", 100, [600, 600, 0, 600, 600, 600, 600]), ("a", "s0", 300, [600] * 9), ("b", "s1", 0, [600, 600, 0, 600, 600])):
        rows += [(trip, segment, i + 1, begin + i, float(r)) for i, r in enumerate(rpm)]
    df = spark.createDataFrame(rows, "trip_id string, segment_id string, row_in_segment int, t long, rpm double")
    for c in ("ambient_temp", "pedal_slope", "rpm_slope", "speed_std", "maf_std", "rpm_std", "accel_pedal_mean_std", "intake_temp_stability", "map_range", "pedal_mapping_residual", "segment_gap_seconds", "coolant_temp", "intake_temp"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumns({"thermal_state": F.lit("post_warmup"), "operating_state": F.lit("post_warmup__high_load"), "later_start": F.lit(False)})
    got = {(r["selector"], r["trip_id"]): (r["segment_id"], r["first_row"], r["first_t"]) for r in campaign.all_windows(df, {"engine_firing": 3, "post_warmup_high_load": 5, "cold_start_ect": 1}).collect()}
    assert got == {("engine_firing", "a"): ("s1", 4, 103), ("post_warmup_high_load", "a"): ("s1", 1, 100), ("post_warmup_high_load", "b"): ("s1", 1, 0)}


def test_history_holds_all_risks_of_a_component(spark):
    rows = [(i, "t", "s", i, "p", 0.9, ("q" if i % 2 else "p2", 0.5)) for i in range(200)] + [(7, "u", "s", 0, "q", 0.3, None)]
    df = spark.createDataFrame(rows, "end_t long, trip_id string, segment_id string, window_no int, anomaly_type string, risk_score double, secondary_risk struct<anomaly_type:string,risk_score:double>").repartition(6)
    got = sorted((r["anomaly_type"], r["place"], r["end_t"], r["secondary"]) for r in records.component_history(df).collect())
    q = [(t, True) for t in range(1, 200, 2)]
    q = sorted([*q, (7, False)])
    assert [x for x in got if x[0] == "p"] == [("p", i + 1, i, False) for i in range(200)] and len(got) == 401
    assert sorted((t, s) for n, _, t, s in got if n == "q") == q and [p for n, p, *_ in got if n == "q"] == list(range(1, 102))


def test_local_times_are_placed_or_told(spark):
    from roadlens.operators import ingest

    rows = [("2018-03-25", "01:59:59.9"), ("2018-03-25", "02:30:00.0"), ("2018-03-25", "03:00:00.0"), ("2018-10-28", "01:59:59.0"), ("2018-10-28", "02:00:00.0"), ("2018-10-28", "02:59:59.9"), ("2018-10-28", "03:00:00.0"), ("2018-06-01", "noon"), ("2018-06-01", None)]
    df = spark.createDataFrame([(i, f"{d}_Seat_Leon_A_B_Frei.csv", t) for i, (d, t) in enumerate(rows)] + [(9, "2018-06-01_odd.csv", "08:00:00.0")], "i int, file string, time string")
    got = {r["i"]: r for r in ingest.with_times(df).collect()}
    assert [got[i]["time_fault"] for i in range(10)] == [None, "nonexistent", None, None, "ambiguous", "ambiguous", None, "malformed", "malformed", "malformed"]
    assert all((r["us"] is None) == (r["time_fault"] is not None) for r in got.values()) and got[2]["us"] - got[0]["us"] == 100_000
    assert {(r["time_fault"], r["rows"]) for r in ingest.time_faults(ingest.with_times(df)).collect()} == {("nonexistent", 1), ("ambiguous", 2), ("malformed", 2), ("malformed", 1)}
    with pytest.raises(Exception, match="nonexistent"):
        ingest.with_times(df.where("i = 1"), strict=True).select("us").collect()


def test_sentinels_and_rules_across_fields(spark):
    from roadlens.operators import cleaning

    rows = [(-40.0, 800.0, 0.0, 50.0, 10.0, 5.0), (150.0, 0.0, 3.0, 50.0, 10.0, 5.0), (20.0, 800.0, 0.0, -1.0, 6.0, 0.0), (101.0, 0.0, 0.0, -1.0, 5.0, 0.0), (-41.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "intake_temp double, rpm double, speed double, coolant_temp double, ambient_temp double, maf double")
    got = [r[0] for r in df.select(cleaning.quality_flags(("intake_temp", "rpm"))).collect()]
    assert got == ["intake_temp_suspicious", "intake_temp_suspicious|rpm_zero_while_speed_positive", "maf_zero_while_rpm_positive|coolant_below_zero_in_warm_ambient", "intake_temp_suspicious", "intake_temp_hard_invalid"]


def test_features_dealt_out_by_segment_are_not_dealt_out_again(spark):
    signals = ("rpm", "speed", "ambient_temp", "accel_pedal_d", "map", "coolant_temp", "intake_temp", "maf", "accel_pedal_e")
    rows = spark.range(400).select(F.format_string("t%d", F.col("id") % 2).alias("trip_id"), F.format_string("s%d", F.col("id") % 4).alias("segment_id"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("row_in_segment"), *[(F.col("id") * (i + 3) % 97).cast("double").alias(s) for i, s in enumerate(signals)])
    lengths, keys = {"span": 9, "long": 6, "short": 3}, ("trip_id", "segment_id")
    features = written_by(campaign.recomputed(rows.repartition(4, *keys), **lengths), "features", keys, 4)
    changed = features.where("row_in_segment between 40 and 44").select(*keys, "row_in_segment", (F.col("maf") * 2).alias("maf"))
    got = campaign.recomputed_about(features, changed, **lengths)
    whole = campaign.recomputed(rows.withColumn("maf", F.when(F.col("row_in_segment").between(40, 44), F.col("maf") * 2).otherwise(F.col("maf"))), **lengths)
    told = lambda df: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select(*rows.columns, *campaign.RECOMPUTED).collect())
    assert told(got) == told(whole)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = campaign.recomputed_about(features, changed, **lengths)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
