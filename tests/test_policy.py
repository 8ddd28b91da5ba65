"""What a report may not claim, given its record."""

import pytest
from pyspark.sql import functions as F

from roadlens.operators.text_audit import policy_check

SCHEMA = "text string, level string, kind string, signals array<struct<feature:string,value:double,reference_range:array<double>>>, proxied boolean, actions array<string>"
COLD, FINE, HOT = ([("coolant_temp", v, [90.0, 95.0])] for v in (80.0, 92.0, 99.0))
CASES = [
    ("It will soon cross into the high risk zone", "High", "x", FINE, False, [], ["future_high"]),
    ("High risk in about 9 drive cycles", "high", "x", FINE, False, [], ["future_high"]),
    ("It will soon cross into the high risk zone", "Medium", "x", FINE, False, [], []),
    ("Seek prompt repair", "Medium", "x", FINE, False, [], ["urgency"]),
    ("No prompt repair is needed", "Medium", "x", FINE, False, [], []),
    ("Seek prompt repair", "High", "x", FINE, False, [], []),
    ("An elevated coolant temperature", "Low", "x", COLD, False, [], ["reversed_signal"]),
    ("An elevated coolant temperature", "Low", "x", HOT, False, [], []),
    ("Coolant temperature was lower", "Low", "x", HOT, False, [], ["reversed_signal"]),
    ("The sensor is functioning correctly", "Low", "x", FINE, False, [], ["system_normal"]),
    ("The sensor is functioning correctly", "Low", "x", [*FINE, ("map", None, [1.0, 2.0])], False, [], []),
    ("The sensor is functioning correctly", "Low", "x", [], False, [], []),
    ("A fault is there", "Low", "x", FINE, True, [], ["unproved_fault"]),
    ("A fault is there", "Low", "x", HOT, True, [], []),
    ("A default is there", "Low", "x", FINE, True, [], []),
    ("Fine", "Low", "x", FINE, False, [" STOP driving and seek help if: the Pedal sticks", None], ["foreign_stop"]),
    ("Fine", "Low", "accelerator_pedal_sensor", FINE, False, ["Stop driving and seek help if: the pedal sticks"], []),
    ("Fine", "Low", None, FINE, False, ["Check the pedal"], []),
    (None, None, None, None, None, None, []),
    ("Urgent fault: the system operates normally", "Medium", "x", FINE, True, ["Stop driving and seek help if: pedals stick"], ["urgency", "system_normal", "unproved_fault", "foreign_stop"]),
]


@pytest.fixture(scope="module")
def checked(spark):
    df = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(CASES)], f"i int, {SCHEMA}")
    v = policy_check(F.col("text"), F.col("level"), F.col("kind"), F.col("signals"), F.col("proxied"), F.col("actions"))
    return {r["i"]: r["v"] for r in df.select("i", v.alias("v")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_policy(checked, i):
    want = CASES[i][-1]
    assert checked[i]["warnings"] == want and checked[i]["passed"] == (not want) and checked[i]["score"] == pytest.approx(max(0.0, 1 - 0.4 * len(want)))
