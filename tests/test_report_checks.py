"""Sections of a report, their evidence, retrieved texts and the parts of primary records."""

import time

import pytest
from pyspark.sql import functions as F

from roadlens.operators import report_checks as r

FINE = "The coolant of this car stays a little under the range that one would expect after so long a drive in town."
SIGNAL = "array<struct<feature:string,value:double,reference_range:array<double>>>"


def words(n):
    return " ".join(["word"] * n)


@pytest.mark.parametrize(
    "text, score, warnings",
    [
        (FINE, 1.0, []), (None, 0.0, ["empty"]), (" ", 0.0, ["empty"]), ("Error: no answer", 0.0, ["error"]), (words(19), 0.8, ["short"]), (words(20), 1.0, []), (words(60), 1.0, []), (words(61), 0.6, ["long"]), (words(300_000), 0.6, ["long"]),
        (FINE + " The MAF is low.", 0.8, ["raw_field:maf"]), (FINE + " The mass airflow (MAF) is low.", 1.0, []), (FINE + " Mapping is fine.", 1.0, []), (FINE + " It has failed, no doubt.", 0.8, ["certainty:has failed"]), (FINE + " It is not confirmed.", 1.0, []),
        (FINE + " At 1.5, 2 and 3.", 1.0, []), (FINE + " At 1, 2, 3 and -4.", 0.8, ["measurements"]), (FINE + " At 1.25 V.", 0.8, ["precision"]), (FINE + " The risk ( 83 % ) is known.", 0.6, ["risk_score"]), (FINE + " With 90% confidence.", 0.6, ["confidence"]),
        (FINE + " A chance of failure.", 0.6, ["failure_probability"]), (FINE + " Have it seen to within the next few trips.", 0.6, ["service_interval"]),
        (FINE + " MAF, MAP and TPS: risk score 1.25, 2, 3, 4, 90% confidence.", 0.0, ["raw_field:maf", "raw_field:map", "raw_field:tps", "precision", "measurements", "risk_score", "confidence"]),
    ],
)
def test_description(spark, text, score, warnings):
    v = spark.createDataFrame([(text,)], "t string").select(r.check_description(F.col("t")).alias("v")).first()["v"]
    assert (v["score"], v["passed"], v["warnings"]) == (pytest.approx(score), score >= 0.8, warnings)


@pytest.mark.parametrize(
    "text, description, score, warnings",
    [
        (FINE + " This may indicate a leak.", None, 1.0, []), (FINE, "", 0.8, ["unhedged"]), (FINE + " Nothing is confirmed.", "", 0.6, ["unhedged", "certainty:confirmed"]), (FINE + " It is not confirmed.", "", 1.0, []),
        (FINE + " It might be so.", FINE, 0.6, ["repetition"]), (FINE + " It might be so.", FINE[:50], 1.0, []), (words(128) + " might be", "", 1.0, []), (words(129) + " might be", "", 0.6, ["long"]),
        ("It might be the fan.", "", 0.8, ["short"]), ("The fan.", "", 0.6, ["unhedged", "short"]), (None, FINE, 0.0, ["empty"]),
    ],
)
def test_cause(spark, text, description, score, warnings):
    v = spark.createDataFrame([(text, description)], "t string, d string").select(r.check_cause(F.col("t"), F.col("d")).alias("v")).first()["v"]
    assert (v["score"], v["passed"], v["warnings"]) == (pytest.approx(score), score >= 0.8, warnings)


def lines(spark, kind, level, signals, probability=None, cycles=None, notes=None):
    df = spark.createDataFrame([(kind, level, signals, probability, cycles, notes)], f"k string, l string, s {SIGNAL}, p double, c long, n array<string>")
    return df.select(r.evidence(*map(F.col, "klspcn"), ("rules",)).alias("e")).first()["e"]


def test_evidence(spark):
    cold, warming, air = ("coolant_temp", 80.0, [90.0, 95.0]), ("ect_rate_180s", 9.0, [0.0, 4.0]), ("maf", 9.0, [0.0, 9.0])
    assert lines(spark, None, None, None) == ["component unknown", "risk Unknown"]
    got = lines(spark, "cooling_degradation", "Low", [cold, warming, air], 0.004, None, [None, "by rules"])
    assert got[2:] == ["signal coolant_temp 80.0 ABNORMAL", "signal ect_rate_180s 9.0 ABNORMAL", "signal maf 9.0 NORMAL", "pattern thermal_stress_pattern", "chance of high risk 0.40%", "cycles to high risk unknown", "caution low_rising", "found by rules, not by the forecast"]
    got = lines(spark, "cooling_degradation", "HIGH", [cold, ("maf", None, [0.0, 9.0])], 0.5, 3, ["repaired"])
    assert got[2:] == ["signal coolant_temp 80.0 ABNORMAL", "signal maf UNKNOWN", "one abnormal signal coolant_temp", "projection withheld: risk is high now", "caution ambiguous"]
    got = lines(spark, "intake_anomaly", None, [cold, ("rpm", 9.0, [10.0, 20.0])], None, 3)
    assert got[2:] == ["signal coolant_temp 80.0 ABNORMAL", "signal rpm 9.0 ABNORMAL", "several abnormal signals coolant_temp, rpm", "cycles to high risk 3"]
    assert [lines(spark, "x", "Low", [], p)[2] for p in (0.0, 0.5, 0.125)] == ["chance of high risk 0%", "chance of high risk 50%", "chance of high risk 12.5%"]


def test_retrieved_texts(spark):
    rows = [(None, None), ("", None), (" No specific fault knowledge", None), ("It OVERHEATED.", None), ("It OVERHEATED.", "ambiguous"), ("A radiator blocked by leaves", "low_rising"), ("A fan", "ambiguous")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, t string, p string")
    assert [x["u"] for x in df.orderBy("i").select(r.usable_knowledge(F.col("t"), F.col("p")).alias("u")).collect()] == [False, False, False, True, False, False, True]
    texts = [None, " ", "No specific action guidance.\nCheck it", "Check it\r\n REPLACE it \n\n See it", "Clear fault codes", "Replaceable parts: none\rClear the diagnostic memory"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [x["a"] for x in df.orderBy("i").select(r.owner_actions(F.col("t")).alias("a")).collect()] == [[], [], [], ["Check it", "See it"], [], ["Replaceable parts: none"]]


def test_primary_records(spark):
    rows = [(i, f"s{i % 8}" if i % 11 else None, None if i % 5 else "bad", "primary" if i % 3 else "secondary", 7) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, segment_id string, error string, evaluation_role string, part_of int")
    want = {x[0] for x in rows if x[2] is None and x[3] == "primary"}
    got = r.primary_records(df).collect()
    order = sorted({rows[i][1] for i in want}, key=lambda s: (s is not None, s or ""))
    assert {x["i"] for x in got} == want and len(got) == len(want)
    assert all((x["part"] == "hold_out") == (order.index(x["segment_id"]) % 3 == 2) for x in got)
    assert not r.primary_records(df.limit(0)).count()


def test_report_quality(spark):
    long, hedge = "Have the cooling system checked soon by a garage that you trust.", "The reading may be low."
    rows = [
        ("All is well at 3.", hedge, [long, long], "3 of 4", "High", (1.0, 1.0, 1.0, 1.0)), ("All is well at -3.", hedge, [long, long], "3 of 4", "High", (0.6, 1.0, 1.0, 1.0)), (None, None, None, None, None, (0.7, 1.0, 0.6, 0.4)),
        ("It has failed.", "It is broken.", ["Monitor it."], "", "High", (0.7, 1.0, 0.0, 0.1)), ("See the MAF.", hedge, [long] * 5, "", "medium", (1.0, 0.4, 1.0, 0.8)), ("See the IAT (intake air).", hedge, [long, None], "", "low", (1.0, 1.0, 1.0, 0.4)),
        (words(31), "The fault is not confirmed. The value is low.", [long, long], "", "Low", (1.0, 0.8, 1.0, 0.7)), ("See the IAT.", "The value is not certain.", [long, long], "", "HIGH", (1.0, 0.7, 1.0, 1.0)),
    ]
    df = spark.createDataFrame([(i, *x[:5]) for i, x in enumerate(rows)], "i int, d string, c string, a array<string>, x string, l string")
    got = df.orderBy("i").select(r.report_quality(*map(F.col, "dcaxl")).alias("v")).collect()
    for (*_, want), g in zip(rows, got):
        assert tuple(g["v"][:4]) == pytest.approx(want) and g["v"]["mean"] == pytest.approx(sum(want) / 4)


def test_cause_of_many_words_takes_linear_time(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(f"might {text}", f"v {text}"), (f"might {text}", " ".join(f"v{i}" for i in range(20_000)))], "cause string, description string")
    began = time.monotonic()
    got = [r["v"]["warnings"] for r in df.select(r.check_cause(F.col("cause"), F.col("description")).alias("v")).collect()]
    assert got == [["repetition", "long"], ["long"]] and time.monotonic() - began < 30
