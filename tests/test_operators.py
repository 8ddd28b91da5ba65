"""Boundary cases with results worked out by hand."""

import datetime as dt
import glob
import os
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from roadlens.functions.physics import norm_cdf, parse_bool, round_significant
from roadlens.operators import assembly, campaign, cleaning, continuity, features, gates, ingest, ranks, rolling, rules, scoring
from roadlens.operators.conditions import smooth_states
from roadlens.plans.registry import queries
from roadlens.plans.rules import samples as samples_of
from roadlens.plans.rules import state
from roadlens.sources import sinks
from roadlens.sources.adapters import ticks
from roadlens.sources.scratch import written_by
from roadlens.streaming import live

FLAGS = ("is_imputed", "is_suspicious", "had_hard_invalid_source")


def samples(spark, values, t=None, seg="s1", flags=None):
    rows = [("trip_0001", seg, i + 1, (t or range(100, 100 + len(values)))[i], v, *(flags or {}).get(i, (False, False, False))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "trip_id string, segment_id string, row_in_segment int, t long, maf double, " + ", ".join(f"maf_{f} boolean" for f in FLAGS))


def test_blocks_break_on_bad_flags_nulls_and_steps(spark):
    df = samples(spark, [1.0, 1.0, None, 1.0, 1.0, 1.0, 1.0], t=[1, 2, 3, 4, 5, 7, 8], flags={4: (False, None, False)})
    got = [(r["break_reason"], r["block_id"]) for r in continuity.continuity(df, continuity.quality_valid(["maf"])).orderBy("row_in_segment").collect()]
    assert got == [("dataset_start", 1), ("continuous", 1), ("invalid_sample", None), ("previous_sample_invalid", 2), ("invalid_sample", None), ("previous_sample_invalid", 3), ("continuous", 3)]


def test_persistence_needs_n_samples_in_one_block(spark):
    df = continuity.local_blocks(samples(spark, [0.0] * 4 + [None] + [0.0] * 5), continuity.quality_valid(["maf"]))
    got = [r["persists"] for r in continuity.persistence(df, F.col("maf") == 0, 5).orderBy("row_in_segment").collect()]
    assert got == [False] * 9 + [True]


def test_short_runs_take_over_the_left_neighbour():
    assert smooth_states(list("aaabbaaa")) == list("aaaaaaaa")
    assert smooth_states(list("abbbb")) == list("bbbbb")
    assert smooth_states(["unknown", "a", "unknown"]) == ["unknown", "a", "unknown"]
    assert smooth_states(list("aaabcddd")) == list("aaaaaddd")
    assert smooth_states([]) == []


def test_only_whole_short_gaps_are_filled(spark):
    v = [1.0, None, None, 4.0, None, None, None, 8.0, None]
    df = spark.createDataFrame([("t", 1, i, x) for i, x in enumerate(v)], "trip_id string, segment int, bin int, value double")
    got = [r["value_filled"] for r in cleaning.fill_short(df, "value").orderBy("bin").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]
    forward = [r["value_filled"] for r in cleaning.fill_short(df, "value", strategy="forward_fill").orderBy("bin").collect()]
    assert forward == [1.0, 1.0, 1.0, 4.0, None, None, None, 8.0, 8.0]


def test_local_time_and_summer_time(spark):
    zone = "Europe/Berlin"
    df = spark.createDataFrame([("2018-03-01", "10:00:00.500"), ("2018-03-25", "02:30:00"), ("2018-10-28", "02:30:00"), ("x", "y")], "d string, h string")
    local = F.try_to_timestamp(F.concat_ws(" ", "d", "h"))
    utc = cleaning.to_utc(F.col("d"), F.col("h"), zone)
    got = df.select(utc.cast("string").alias("u"), cleaning.local_time_exists(utc, local, zone).alias("e"), cleaning.local_time_ambiguous(utc, local, zone).alias("a")).collect()
    assert got[0]["u"] == "2018-03-01 09:00:00.5" and got[0]["e"] and not got[0]["a"]
    assert got[1]["e"] is False and got[2]["a"] is True and got[3]["u"] is None


def test_small_functions(spark):
    df = spark.createDataFrame([("TRUE", 0.0), ("0", 1.96), ("maybe", -1.0)], "b string, z double")
    got = df.select(parse_bool(F.col("b")).alias("b"), F.round(norm_cdf(F.col("z")), 4).alias("p"), round_significant(F.col("z") * 1234.5678, 3).alias("s")).collect()
    assert [r["b"] for r in got] == [True, False, None] and [r["p"] for r in got] == [0.5, 0.975, 0.1587] and [r["s"] for r in got] == [0.0, 2420.0, -1230.0]


def test_projection(spark):
    rising = [("c", i, x, i) for i, x in enumerate((0.19, 0.27, 0.34, 0.42, 0.505, 0.585))]
    few, high = [("f", i, 0.2, i) for i in range(4)], [("h", i, 0.5 + i / 10, i) for i in range(5)]
    df = spark.createDataFrame(rising + few + high + [("o", 0, 0.1, 0)], "component string, trip_id long, risk double, cycle long")
    got = {r["component"]: r for r in scoring.project(df, "component").collect()}
    assert got["c"]["cycles"] == 4 and got["c"]["probability"] > 0.99
    assert got["f"]["probability"] is None and got["o"]["cycles"] is None
    assert got["h"]["cycles"] == 0 and got["h"]["probability"] == 1.0


def test_sinks(spark, tmp_path):
    schema = "trip_id string, window_id string, key_signals array<struct<feature:string,value:double,unit:string,reference_range:array<double>>>"
    df = spark.createDataFrame([("t", "w", [("maf", 5.0, "g/s", [0.0, 4.0]), ("rpm", 800.0, "rpm", [600.0, 900.0]), ("tps", None, "%", None)])], schema)
    assert [r["status"] for r in sinks.key_signal_rows(df).collect()] == ["ABNORMAL", "NORMAL", "Unknown"]
    sinks.write_table(df.drop("key_signals"), f"{tmp_path}/t", ("trip_id",))
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    (tmp_path / "one.json").write_text('{"trip_id": "a", "score": 0.5}')
    (tmp_path / "many.json").write_text('{"windows": [{"trip_id": "b", "score": 0.1}, {"trip_id": "c", "score": 0.2}]}')
    got = sinks.read_model_output(spark, f"{tmp_path}/*.json", "trip_id string, score double").orderBy("trip_id").collect()
    assert [tuple(r) for r in got] == [("a", 0.5), ("b", 0.1), ("c", 0.2)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_records_as_json_take_no_file_each(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/records-*"))
    n = queries()["s12_x23_x24_record_json"](spark, "/root/testdata/sf0.001").count()
    (made,) = set(glob.glob(f"{folder}/records-*")) - before
    files = glob.glob(f"{made}/**/*.txt", recursive=True)
    assert n > 50 and 0 < len(files) <= 10 and not glob.glob(f"{made}/*/")


def test_fills_of_all_columns_against_brute_force(spark):
    rng, columns = random.Random(5), ("a", "b", "c")
    cells = {s: [[rng.choice([None, None, float(i), float(i * i)]) for _ in columns] for i in range(rng.choice([1, 2, 3, 40]))] for s in range(30)}
    df = spark.createDataFrame([("t", s, i * 3 + i % 3, *row) for s, rows in cells.items() for i, row in enumerate(rows)], "trip_id string, segment int, bin long, a double, b double, c double")
    for longest in (1, 2, 4):
        got = {(r["segment"], r["bin"]): r for r in cleaning.fill_all_short(df, dict(zip(columns, ("interpolation", "forward_fill", "retain"))), longest).collect()}
        assert len(got) == sum(map(len, cells.values()))
        for s, rows in cells.items():
            at = [i * 3 + i % 3 for i in range(len(rows))]
            for j, c in enumerate(columns):
                v = [r[j] for r in rows]
                want = list(v)
                for i in range(len(v)):
                    if v[i] is None:
                        lo = max((k for k in range(i) if v[k] is not None), default=-1)
                        hi = min((k for k in range(i + 1, len(v)) if v[k] is not None), default=len(v))
                        if hi - lo - 1 <= longest and lo >= 0 and c == "b":
                            want[i] = v[lo]
                        if hi - lo - 1 <= longest and lo >= 0 and hi < len(v) and c == "a":
                            want[i] = v[lo] + (v[hi] - v[lo]) * (at[i] - at[lo]) / (at[hi] - at[lo])
                assert [got[s, x][f"{c}_filled"] for x in at] == want
                assert [got[s, x][f"{c}_is_imputed"] for x in at] == [w is not None and x is None for w, x in zip(want, v)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_cleaning_sorts_a_task_a_few_times_only(spark):
    plan = queries()["d01_p09_clean_recordings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") + plan.count("Window[") <= 8 and "SortMergeJoin" not in plan and plan.count("bin#") > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_samples_are_dealt_out_once(spark):
    df = samples_of(spark, "/root/testdata/sf0.001")
    for made in (rules.rule_state(df), continuity.local_blocks(df, F.lit(True)).groupBy("trip_id", "segment_id", "block").count()):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert rules.rule_state(df).count() == df.count() > 0


def test_densify_brings_each_empty_bin_once(spark):
    bins = spark.createDataFrame([("t", 1, 5, 1.0), ("t", 1, 6, None), ("t", 1, 9, 2.0), ("t", 2, 3, 4.0)], "trip_id string, segment int, bin long, v double")
    got = [tuple(r) for r in cleaning.densify(bins).collect()]
    assert sorted(got, key=str) == sorted([("t", 1, 5, 1.0), ("t", 1, 6, None), ("t", 1, 7, None), ("t", 1, 8, None), ("t", 1, 9, 2.0), ("t", 2, 3, 4.0)], key=str)


def test_one_key_of_many_rows_takes_linear_time(spark):
    n = 300_000
    left = spark.range(n).selectExpr("'k' AS by", "id", "id * 2 AS t")
    right = spark.range(n).selectExpr("'k' AS by", "id AS r_id", "id * 2 + 1 AS r_t")
    began = time.time()
    got = gates.asof_nearest(left, right, "by", 5).agg(F.sum("distance"), F.count("*")).first()
    assert tuple(got) == (n, n)
    rows = spark.range(n).selectExpr("'t' AS trip_id", "'s' AS segment_id", "CAST(id + 1 AS INT) AS row_in_segment", "CASE WHEN id % 10 = 0 THEN CAST(id AS DOUBLE) END AS v")
    assert rows.select((rolling.interpolate_both("v") - F.least(F.col("row_in_segment") - 1, F.lit(n - 10))).alias("d")).agg(F.max(F.abs("d"))).first()[0] < 1e-6
    bins = spark.range(n).selectExpr("'t' AS trip_id", "1 AS segment", "id AS bin", "CASE WHEN id % 3 = 0 THEN CAST(id AS DOUBLE) END AS v")
    assert cleaning.fill_short(bins, "v").where("v_filled = bin").count() >= n - 2
    assert time.time() - began < 120


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_features_and_rules_share_one_sort(spark):
    df = state(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    sorts, exchanges = plan.count("+- Sort [") + plan.count("- *(1) Sort ["), plan.count("Exchange hashpartitioning")
    assert plan.count("Sort [") <= 3 and exchanges <= 2, (sorts, exchanges)


def test_ranks_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)])) for _ in range(3000)] + [("c", None), ("d", 5)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = {r["k"]: r["q"] for r in ranks.exact_quantiles(df, ("k",), "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    for k in "ab":
        own = sorted(v for x, v in rows if x == k and v is not None)
        q = statistics.quantiles(own, n=4, method="inclusive")
        assert got[k] == [own[0], q[0], q[1], own[-1]]
    assert got["d"] == [5, 5, 5, 5] and set(got) == set("abd")
    many = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    assert ranks.numbered(many, ("x",), "n").where("n = x + 1").count() == 5000


def test_late_rows_and_repeated_events_of_a_feed(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "trip_id string, ts timestamp, event_id long, value double"
    batches = [[("a", at(0), 1, 1.0), ("a", at(0.5), 2, None), ("a", at(100), 3, 3.0)], [("a", at(101), 5, 5.0)], [("a", at(0.7), 4, 9.0), ("a", at(100), 3, 3.0), ("a", at(300), 6, 6.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (tmp_path / "feed").mkdir(exist_ok=True)
        part = next((tmp_path / str(i)).glob("part-*.parquet"))
        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
        part.rename(tmp_path / "feed" / f"{i}.parquet")
    feed = live.read_feed(spark, f"{tmp_path}/feed", spark.createDataFrame([], schema).schema, files=1)
    got = {(r["bin"]["start"] - at(0)).total_seconds(): (r["value"], r["samples"]) for r in live.run_now(live.stream_resample(feed), "append").collect()}
    assert got == {0.0: (1.0, 2), 100.0: (3.0, 1), 101.0: (5.0, 1)}  # the row of 0.7 s came late; the window of 300 s is open


def test_headers_and_malformed_recordings(spark, tmp_path):
    raw = spark.createDataFrame([("f", "10:00:00", "1")], ["file", "\ufeffTime", " Engine  Coolant Temperature [Â°C]"])
    assert ingest.canonical(raw).columns == ["file", "time", "coolant_temp"]
    with pytest.raises(ValueError):
        ingest.canonical(raw.withColumn("TIME", F.lit("x")))
    good = tmp_path / "in" / "file=2018-03-01_Seat_Leon_RT_S_Normal.csv"
    good.mkdir(parents=True)
    (good / "a.csv").write_text("Time,Engine RPM [RPM]\n10:00:00,800\n10:00:00,900\n10:00:01,\n10:00:04.100,bad\n25:00:00,1\n")
    df = ingest.with_times(ingest.canonical(ingest.read_recordings(spark, f"{tmp_path}/in", ["Time", "Engine RPM [RPM]"])).withColumn("row", F.monotonically_increasing_id()))
    trips = ingest.trips_of(df)
    assert [tuple(r)[2:] for r in trips.collect()] == [(5, 1, "trip_0001")]
    got = [(r["segment_id"][-3:], r["row_in_segment"], r["rpm"], r["rpm_is_imputed"]) for r in ingest.clean(df, trips, ("rpm",)).orderBy("t").collect()]
    assert got == [("001", 1, 900.0, False), ("001", 2, 900.0, True), ("002", 1, None, False)]
    (good / "b.csv").write_text("Time,Engine RPM [RPM]\n10:00:00,800,7\n")
    with pytest.raises(Exception):
        ingest.read_recordings(spark, f"{tmp_path}/in", ["Time", "Engine RPM [RPM]"]).collect()


def test_episodes_take_six_windows_and_compiled_code(spark):
    """Two windows for features and blocks, two for lasting states, two for runs, one of the adapter (F12); steps whose code the JVM would interpret are not generated whole."""
    plan = queries()["w28_duration_episodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 7
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_runs_know_their_start_in_time_and_end_with_their_block(spark):
    df = continuity.local_blocks(samples(spark, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0], t=[5, 6, 7, 8, 20, 21]), continuity.quality_valid(["maf"]))
    df = continuity.runs_of(df, {"zero": F.col("maf") == 0, "any": F.lit(True)})
    got = [(r["zero_start"], r["zero_start_t"], r["any_start"], r["any_start_t"]) for r in df.orderBy("row_in_segment").collect()]
    assert got == [(1, 5, 1, 5), (1, 5, 1, 5), (None, None, 1, 5), (4, 8, 1, 5), (5, 20, 5, 20), (5, 20, 5, 20)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_recordings_take_no_folder_each_and_are_dealt_out_once(spark):
    """As CSV they are a file a task (F3, F4, F6); cleaned, no row of them is dealt out again: what is, is a row a file."""
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/recordings-*"))
    df = queries()["d01_p09_clean_recordings"](spark, "/root/testdata/sf0.001")
    (made,) = set(glob.glob(f"{folder}/recordings-*")) - before
    assert 0 < len(glob.glob(f"{made}/*.csv")) <= 10 and not glob.glob(f"{made}/*/")
    plan = df._jdf.queryExecution().executedPlan().toString().replace("AQEShuffleRead", "")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(file") <= 1 and "Exchange hashpartitioning(trip_id" not in plan
    assert plan.count("Sort [file") <= 2 and df.count() > 0


def test_dates_of_names_agree_with_the_parsed_ones(spark):
    names = ["2018-03-01_Seat_Leon_RT_S_Normal.csv", "2018-03-01_Seat_Leon_RT_S_2_Frei_x_y.csv", "2018-03-01_Seat_Leon_RT_S_Normally.csv", "2018-03-01_Seat_Leon_RT_Frei.csv", "2018-13-01_Seat_Leon_RT_S_Stau.csv",
             "2018-03-01_Seat_Leon_RT_S_Other.csv", "2018-03-01_Seat_Leon_RT_S_Frei.csv.gz", "2018-03-01_Seat_Leon_RT_S__Frei", "_Seat_Leon_RT_S_Frei.csv", "Frei", "", None, "2018-03-01_Frei_Leon_RT_S_x_Frei_Stau.csv", "2018-03-01_Seat_Leon_RT_S_Frei_a.b.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(cleaning.date_of(F.col("n")), cleaning.parse_filename(F.col("n"))["date"]).collect()
    assert all(r[0] == r[1] for r in got) and sum(r[0] is not None for r in got) == 5


def test_dense_fills_agree_with_one_after_the_other(spark):
    rng, columns = random.Random(7), {"a": "interpolation", "b": "forward_fill", "c": "retain"}
    rows = [("t", s, at, *[rng.choice([None, None, float(at), float(at * at)]) for _ in columns], at % 7) for s in range(40) for at in sorted(rng.sample(range(40), rng.choice([1, 2, 5, 20])))]
    df = spark.createDataFrame(rows, "trip_id string, segment int, bin long, a double, b double, c double, other long")
    for longest in (1, 2, 4):
        two = cleaning.fill_all_short(cleaning.densify(df), columns, longest)
        want = sorted((tuple(r) for r in two.select("segment", "bin", "other", *[f"{c}_{x}" for c in columns for x in ("filled", "is_imputed")]).collect()), key=str)
        made = cleaning.dense_filled(df, columns, longest)
        assert sorted((tuple(r) for r in made.select("segment", "bin", "other", *[x for c in columns for x in (c, f"{c}_is_imputed")]).collect()), key=str) == want
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_production_table_deals_out_episodes_and_segments_only(spark):
    """Samples with their features stay where they were written, however large the other sides are (F5, F8)."""
    df, kept = samples_of(spark, "/root/testdata/sf0.001"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = assembly.production_table(df)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 3 and plan.count("Exchange SinglePartition") == 1 and plan.count("Bucketed: true") == 2
        assert made.count() == df.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_scenarios_are_made_where_their_segments_are(spark):
    """Samples dealt out by segment are not dealt out again when scenarios are made of them: only segments are, a row each (F7)."""
    base, kept = continuity.with_quality(ticks(spark, "/root/testdata/sf0.001")), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    base = written_by(base.withColumn("operating_state", F.lit("x")).repartition(4, "segment_id"), "base", ("segment_id",), 4)
    windows = base.groupBy("trip_id").agg(F.min("segment_id").alias("segment_id")).withColumn("first_row", F.lit(3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = campaign.expand(base, windows, "accel_pedal_e", "relative_offset", [("apart", 5, {"reference": "accel_pedal_d", "offset": 40.0})])
        plan = rules.rule_state(features.production(df))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Union" not in plan
        put = df.where("trip_id like 'apart|%'").join(windows.withColumnRenamed("segment_id", "at").drop("trip_id").distinct(), F.col("segment_id") == F.col("at")).where("row_in_segment between 3 and 7")
        assert put.where("not accel_pedal_e <=> accel_pedal_d + 40 or accel_pedal_e_ok <> (accel_pedal_d is not null)").isEmpty() and put.count() > 0
        assert df.count() == 2 * base.count() and df.where("trip_id like 'baseline|%'").select(*[c for c in base.columns if c != "trip_id"]).exceptAll(base.drop("trip_id")).isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
