"""Checks of a report's description and cause by the published bounds, the evidence that both are written from, and what retrieved texts may enter it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.operators.ranks import numbered
from roadlens.operators.records import known_correlations
from roadlens.operators.text_audit import let, sentences, shared_shingle, text_stats, unnegated, unsupported_numbers

# Fields with the wordings that explain them, phrases, patterns and bounds in words.
RAW_FIELDS = {
    "coolant_temp": (), "maf": ("mass airflow", "mass air flow"), "map": ("manifold pressure", "manifold absolute pressure"),
    "accel_pedal_d": ("accelerator pedal",), "accel_pedal_e": ("accelerator pedal",), "tps": ("throttle position",),
}
CONFIRMED = ("confirmed", "is definitely", "has failed", "is broken")
HEDGED = ("may indicate", "could suggest", "could be related to", "might", "possibly", "could be", "possible explanation")
CERTAINTY = ("confirmed", "definite", "certain")
SCORE_TOLD = r"\b(?:risk score|% score)\b|\brisk(?: level)?\s*\(\s*\d+(?:\.\d+)?\s*%\s*\)"
CONFIDENCE_TOLD = r"\b\d+(?:\.\d+)?\s*%\s*confidence\b"
FAILURE_TOLD = r"\b(?:chance|probability)\b.{0,35}\b(?:immediate )?failure\b"
INTERVAL_TOLD = r"\bwithin (?:the )?(?:next )?(?:few|several|couple of) (?:drive cycles|trips|days|weeks|months)\b"
OVERHEATING = r"(?i)\b(?:overheat(?:ing|ed)?|high coolant temperature|thermostat stuck closed|radiator blocked)\b"
WORKSHOP_ONLY = r"(?i)\b(?:replace|replacement|clear (?:the )?(?:fault|diagnostic)|relearn|in turbo engines)\b"
SHORTEST, LONGEST_DESCRIPTION, LONGEST_CAUSE, MOST_NUMBERS, LEAST_PASS = 20, 60, 130, 3, 8
NOTHING_FOUND = ("No specific fault knowledge", "No specific action guidance")

_yes = lambda c: F.coalesce(c, F.lit(False))
_bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")  # noqa: E731  white space of any kind


def _verdict(text: Column, tests: list[tuple[Column, Column, int]]) -> Column:
    """Struct (score, passed, warnings): of each test (name, condition, tenths) that holds, the tenths are taken off. Blank texts and error messages score nothing."""
    useless = F.when(_bare(text) == "", F.lit("empty")).when(F.startswith(_bare(text), F.lit("Error:")), F.lit("error"))
    held = F.array_compact(F.array(*[F.when(_yes(c), F.struct(n.alias("name"), F.lit(t).alias("tenths"))) for n, c, t in tests]))
    none = F.struct(F.array(useless).alias("told"), F.lit(0).alias("left"))
    told = let(held, lambda h: F.struct(F.transform(h, lambda x: x["name"]).alias("told"), F.greatest(F.lit(0), F.lit(10) - F.aggregate(h, F.lit(0), lambda n, x: n + x["tenths"])).alias("left")))
    return let(F.when(useless.isNotNull(), none).otherwise(told), lambda v: F.struct((v["left"] / 10).alias("score"), (v["left"] >= LEAST_PASS).alias("passed"), v["told"].alias("warnings")))


def _certain(text: Column) -> tuple[Column, Column, int]:
    first = F.get(unnegated(text, CONFIRMED), F.lit(0))
    return F.concat(F.lit("certainty:"), first), first.isNotNull(), 2


def check_description(text: Column) -> Column:
    """Struct (score, passed, warnings) of a description: 20 to 60 words, no field name without its explanation, no
    fault told as certain, at most three numbers, none of two decimals, no score, confidence, chance of failure or service interval."""
    t, words = F.lower(text), text_stats(text)["words"]
    numbers = F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?%?"), 0)
    tests = []
    for field, explained in RAW_FIELDS.items():
        named = t.rlike(rf"\b{field}\b")
        for e in explained:
            named = named & ~F.contains(t, F.lit(e))
        tests.append((F.lit(f"raw_field:{field}"), named, 2))
    tests += [
        _certain(text), (F.lit("short"), words < SHORTEST, 2), (F.lit("long"), words > LONGEST_DESCRIPTION, 4),
        (F.lit("precision"), F.exists(numbers, lambda x: x.rlike(r"\.[0-9]{2}")), 2), (F.lit("measurements"), F.size(numbers) > MOST_NUMBERS, 2),
        (F.lit("risk_score"), t.rlike(SCORE_TOLD), 4), (F.lit("confidence"), t.rlike(CONFIDENCE_TOLD), 4), (F.lit("failure_probability"), t.rlike(FAILURE_TOLD), 4), (F.lit("service_interval"), t.rlike(INTERVAL_TOLD), 4),
    ]
    return _verdict(text, tests)


def check_cause(text: Column, description: Column) -> Column:
    """Struct (score, passed, warnings) of a cause: 20 to 130 words, hedged by a phrase or by certainty that is denied, no fault told as certain, no twelve words in a row of the description."""
    t, words = F.lower(text), text_stats(text)["words"]
    contains = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p))
    denied = contains(CERTAINTY) & (F.size(unnegated(text, CERTAINTY)) == 0)
    tokens = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), 0)
    tests = [
        (F.lit("unhedged"), ~(contains(HEDGED) | denied), 2), _certain(text), (F.lit("repetition"), shared_shingle(text, description, words=tokens), 4),
        (F.lit("long"), words > LONGEST_CAUSE, 4), (F.lit("short"), words < SHORTEST, 2),
    ]
    return _verdict(text, tests)


def cooling_pattern(anomaly_type: Column, signals: Column) -> Column:
    """``low_rising`` if the coolant is below its range while it warms faster than its range, ``ambiguous`` if it is below only; null for other records. ``signals``: array of (feature, value, reference_range)."""
    has = lambda name, beyond: _yes(F.exists(signals, lambda s: _yes((s["feature"] == name) & beyond(s))))
    low = _yes(anomaly_type == "cooling_degradation") & has("coolant_temp", lambda s: s["value"] < F.get(s["reference_range"], F.lit(0)))
    return F.when(low & has("ect_rate_180s", lambda s: s["value"] > F.get(s["reference_range"], F.lit(1))), "low_rising").when(low, "ambiguous")


def percent(share: Column) -> Column:
    """A share in per cent: small ones with two decimals, so that they are not told as nothing, others with one or none."""
    p = share * 100
    return F.when(p.isNull(), None).when((p > 0) & (p < 1), F.format_string("%.2f%%", p)).when(p == F.round(p), F.format_string("%d%%", F.round(p).cast("long"))).otherwise(F.format_string("%.1f%%", p))


def evidence(anomaly_type: Column, risk_level: Column, signals: Column, probability: Column, cycles: Column, notes: Column, markers: tuple[str, ...]) -> Column:
    """Array of the lines of evidence of a record: a line a signal with NORMAL or ABNORMAL, the patterns that abnormal signals make
    together, the caution that a cold engine asks for, the projection, unless risk is high already, and where the finding came from.

    ``signals`` is an array of (feature, value, reference_range); null values are neither. ``notes`` of which one holds any of ``markers`` tell that rules decided.
    """
    low, high = (lambda s: F.get(s["reference_range"], F.lit(0))), (lambda s: F.get(s["reference_range"], F.lit(1)))
    outside = lambda s: _yes((s["value"] < low(s)) | (s["value"] > high(s)))
    given = F.coalesce(signals, F.array().cast("array<struct<feature:string,value:double,reference_range:array<double>>>"))
    abnormal = F.transform(F.filter(given, outside), lambda s: s["feature"])
    state = lambda s: F.when(s["value"].isNull(), "UNKNOWN").when(outside(s), "ABNORMAL").otherwise("NORMAL")
    lines = F.transform(given, lambda s: F.concat_ws(" ", F.concat(F.lit("signal "), s["feature"]), s["value"].cast("string"), state(s)))
    known = known_correlations(abnormal)
    together = (
        F.when(F.size(known) > 0, F.transform(known, lambda p: F.concat(F.lit("pattern "), p)))
        .when(F.size(abnormal) > 1, F.array(F.concat(F.lit("several abnormal signals "), F.array_join(abnormal, ", "))))
        .when(F.size(abnormal) == 1, F.array(F.concat(F.lit("one abnormal signal "), F.get(abnormal, F.lit(0)))))
    )
    high_now, projected = _yes(F.lower(risk_level) == "high"), probability.isNotNull() | cycles.isNotNull()
    ahead = F.when(projected & high_now, F.array(F.lit("projection withheld: risk is high now"))).when(
        projected, F.array_compact(F.array(F.concat(F.lit("chance of high risk "), percent(probability)), F.concat(F.lit("cycles to high risk "), F.coalesce(cycles.cast("string"), F.lit("unknown"))))),
    )
    by_rules = _yes(F.exists(notes, lambda n: _yes(F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(n, m)))))
    head = F.array(F.concat(F.lit("component "), F.coalesce(anomaly_type, F.lit("unknown"))), F.concat(F.lit("risk "), F.coalesce(risk_level, F.lit("Unknown"))))
    rest = F.array_compact(F.array(F.concat(F.lit("caution "), cooling_pattern(anomaly_type, signals)), F.when(by_rules, F.lit("found by rules, not by the forecast"))))
    none = F.array().cast("array<string>")
    return F.concat(head, lines, F.coalesce(together, none), F.coalesce(ahead, none), rest)


def usable_knowledge(text: Column, pattern: Column) -> Column:
    """Whether a retrieved text on faults may enter a report: there is one, and it speaks of no overheating where the coolant is below its range (``cooling_pattern``)."""
    t = _bare(text)
    return (t != "") & ~F.startswith(t, F.lit(NOTHING_FOUND[0])) & ~(pattern.isNotNull() & t.rlike(OVERHEATING))


def owner_actions(text: Column) -> Column:
    """Lines of a retrieved text on actions that an owner may be told to ask for: those of replacements, cleared codes and relearning are left out. Empty if none or nothing was found."""
    t = _bare(text)
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), _bare), lambda x: (x != "") & ~x.rlike(WORKSHOP_ONLY))
    return F.when(F.startswith(t, F.lit(NOTHING_FOUND[1])), F.array().cast("array<string>")).otherwise(lines)


def primary_records(records: DataFrame) -> DataFrame:
    """``records`` without an error and of role ``primary``, with ``part``: every third of their segments, in order of id, is held out from calibration.

    Segments are numbered by ranges and joined back by id, so neither the order nor a hot segment passes through one task.
    """
    primary = records.where("error is null and evaluation_role = 'primary'")
    segments = numbered(primary.select("segment_id").distinct(), ("segment_id",), "place")
    part = F.when(F.col("place") % 3 == 0, "hold_out").otherwise("calibration")
    return primary.join(segments.select(F.col("segment_id").alias("_segment"), part.alias("part")), F.col("segment_id").eqNullSafe(F.col("_segment"))).drop("_segment")


# Words and phrases of the four scores of a whole report.
SIGNAL_WORDS = ("signal", "reading", "sensor", "temperature", "pressure", "value", "measurement")
UNREADABLE = ("coolant_temp", "maf", "map", "accel_pedal_d", "accel_pedal_e", "tps", "throttle_pos")
ACRONYMS = ("OBD", "ECM", "PCM", "DTC", "MAF", "MAP", "TPS", "IAT")
HEDGED_REPORT = ("may indicate", "could suggest", "could be related to", "might", "possibly", "may be", "could be", "suggests", "possible explanation")
CONFIRMED_REPORT = ("confirmed", "is definitely", "has failed", "is broken", "is faulty", "has malfunctioned", "is damaged")
FAULT_CLAIMS = ("the fault is", "the problem is", "has failed", "is broken", "is faulty")
CUES = {"high": ("soon", "prompt", "immediately", "avoid", "urgent"), "medium": ("soon", "check", "inspect", "schedule"), "low": ("monitor", "next service", "when convenient", "observe")}


def report_quality(description: Column, cause: Column, actions: Column, context: Column, risk_level: Column) -> Column:
    """Struct of grounding, readability, hedging and actionability, each from 1 down by published deductions, and their mean.

    Grounding: numbers of the description stand in the context, the cause speaks of signals. Readability: no field names, no
    acronym without an explanation in brackets, at most 30 words a sentence. Hedging: the cause is hedged, nothing is told as
    certain. Actionability: two to four actions of ten words or more, with a cue that fits the risk. Null texts are empty, null actions none.
    """
    none = F.lit("")
    description, cause, context = F.coalesce(description, none), F.coalesce(cause, none), F.coalesce(context, none)
    actions = F.transform(F.coalesce(actions, F.array().cast("array<string>")), lambda x: F.coalesce(x, none))
    count = lambda x: F.size(F.array_remove(F.split(x, r"\s+"), ""))
    has = lambda text, phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))
    said, both = F.lower(cause), F.concat_ws(" ", description, cause)
    bare = F.lit(False)
    for a in ACRONYMS:
        bare = bare | (both.rlike(rf"\b{a}\b") & ~both.rlike(rf"{a}\s*\([^)]+\)|\([^)]*{a}[^)]*\)"))
    parts = sentences(description)
    long = F.aggregate(parts, F.lit(0), lambda n, x: n + count(x)) > 30 * F.size(parts)
    hedged = has(said, HEDGED_REPORT) | (has(said, CERTAINTY) & (F.size(unnegated(cause, CERTAINTY)) == 0))
    certain = (F.size(unnegated(cause, CONFIRMED_REPORT)) > 0) | (F.size(unnegated(description, CONFIRMED_REPORT)) > 0)
    told = F.lower(F.array_join(actions, " "))
    cued = F.lit(False)
    for level, cues in CUES.items():
        cued = cued | (_yes(F.lower(risk_level) == level) & has(told, cues))
    lost = {
        "grounding": [(F.size(unsupported_numbers(description, context)) > 0, 4), (~has(said, SIGNAL_WORDS), 3)],
        "readability": [(has(F.lower(both), UNREADABLE), 3), (bare, 3), (long, 2)],
        "hedging": [(~hedged, 4), (certain, 4), (F.size(unnegated(description, FAULT_CLAIMS)) > 0, 2)],
        "actionability": [(F.size(actions) < 2, 3), (F.size(actions) > 4, 2), (F.exists(actions, lambda x: count(x) < 10), 3), (~cued, 3)],
    }
    left = {n: F.lit(10) - sum((F.when(c, t).otherwise(0) for c, t in tests), F.lit(0)) for n, tests in lost.items()}
    return F.struct(*[(v / 10).alias(n) for n, v in left.items()], (sum(left.values(), F.lit(0)) / 40).alias("mean"))
