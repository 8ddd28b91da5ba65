"""Queries of report sections and their evidence (R-03, R-04, R-13, R-14, P-13). Literals of the oracles are written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import report_checks as r
from roadlens.plans.registry import query
from roadlens.plans.texts import _unneg_sql
from roadlens.sources.adapters import table

_ADDED = (
    "The maf reads 12.345 at 3 of 40 and 7.", "Mass air flow, or maf, may indicate a leak.", "No doubt it has failed.", "It is not confirmed.", "Its risk level (83%) stands out at 71 % confidence.",
    "The chance of an immediate failure is small; see a garage within the next few weeks.", "The tps is definitely off: nothing is certain, though.", "A possible explanation is the hose.",
)
_LONG = "The coolant of this car stays well below the range that one would expect after so long a drive, and it warms up slowly."
_pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at + 1).cast("int"))


def _sections(spark, sf_dir, *more):
    """A description and a cause a turn: whole texts of conversations with phrases after them, bare phrases, blanks and error messages."""
    c, k = F.col("conv_id"), F.col("conv_id") + F.col("turn")
    body = F.when(k % 5 != 0, F.col("text"))
    description = F.when(c % 23 == 0, F.lit(None)).when(c % 23 == 1, " ").when(c % 23 == 2, F.concat(F.lit("Error: "), F.col("text"))).otherwise(F.concat_ws(" ", body, _pick(_ADDED, k % len(_ADDED)), F.when(c % 2 == 0, F.lit(_LONG))))
    cause = F.concat_ws(" ", F.when(k % 3 == 0, F.lit(_LONG)).when(k % 3 == 1, F.col("text")), _pick(_ADDED, (k + 3) % len(_ADDED)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", description.alias("description"), cause.alias("cause"), *more)


_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _ADDED) + "]"
_SEC = f"""sec AS (SELECT conv_id, turn, CASE WHEN conv_id % 23 = 0 THEN NULL WHEN conv_id % 23 = 1 THEN ' ' WHEN conv_id % 23 = 2 THEN 'Error: ' || text
  ELSE concat_ws(' ', CASE WHEN (conv_id + turn) % 5 <> 0 THEN text END, ({_LIST})[1 + (conv_id + turn) % 8], CASE WHEN conv_id % 2 = 0 THEN '{_LONG}' END) END AS description,
 concat_ws(' ', CASE (conv_id + turn) % 3 WHEN 0 THEN '{_LONG}' WHEN 1 THEN text END, ({_LIST})[1 + (conv_id + turn + 3) % 8]) AS cause FROM conversations)"""
_WORDS = "len(list_filter(string_split_regex({x}, '\\s+'), lambda x: x <> ''))"
_first = lambda x: "CASE " + " ".join(f"WHEN {_unneg_sql(p).replace('report', x)} THEN '{p}'" for p in ("confirmed", "is definitely", "has failed", "is broken")) + " END"


def _scored_sql(x: str, tests: list[tuple[str, str, int]]) -> str:
    """CTE t of boolean columns, then score, passed and warnings."""
    lost = " + ".join(f"CASE WHEN coalesce({c}, FALSE) THEN {n} ELSE 0 END" for _, c, n in tests)
    told = ", ".join(f"CASE WHEN coalesce({c}, FALSE) THEN {n} END" for n, c, _ in tests)
    return f"""useless AS (SELECT *, CASE WHEN trim(coalesce({x}, '')) = '' THEN 'empty' WHEN starts_with(trim({x}), 'Error:') THEN 'error' END AS useless FROM m),
g AS (SELECT conv_id, turn, CASE WHEN useless IS NOT NULL THEN 0 ELSE greatest(0, 10 - ({lost})) END AS left_, coalesce(useless, concat_ws(',', {told})) AS warnings FROM useless)
SELECT conv_id, turn, CAST(left_ / 10 AS DOUBLE) AS score, left_ >= 8 AS passed, warnings FROM g"""


@query(
    f"WITH {_SEC}, m AS (SELECT *, lower(description) AS t, {_WORDS.format(x='description')} AS w, regexp_extract_all(description, '-?[0-9]+(?:\\.[0-9]+)?%?') AS nums, {_first('description')} AS sure FROM sec), "
    + _scored_sql(
        "description",
        [
            ("'raw_field:coolant_temp'", "regexp_matches(t, '\\bcoolant_temp\\b')", 2), ("'raw_field:maf'", "regexp_matches(t, '\\bmaf\\b') AND NOT contains(t, 'mass airflow') AND NOT contains(t, 'mass air flow')", 2),
            ("'raw_field:map'", "regexp_matches(t, '\\bmap\\b') AND NOT contains(t, 'manifold pressure') AND NOT contains(t, 'manifold absolute pressure')", 2),
            ("'raw_field:accel_pedal_d'", "regexp_matches(t, '\\baccel_pedal_d\\b') AND NOT contains(t, 'accelerator pedal')", 2), ("'raw_field:accel_pedal_e'", "regexp_matches(t, '\\baccel_pedal_e\\b') AND NOT contains(t, 'accelerator pedal')", 2),
            ("'raw_field:tps'", "regexp_matches(t, '\\btps\\b') AND NOT contains(t, 'throttle position')", 2), ("'certainty:' || sure", "sure IS NOT NULL", 2), ("'short'", "w < 20", 2), ("'long'", "w > 60", 4),
            ("'precision'", "len(list_filter(nums, lambda x: regexp_matches(x, '\\.[0-9][0-9]'))) > 0", 2), ("'measurements'", "len(nums) > 3", 2),
            ("'risk_score'", "regexp_matches(t, '\\b(?:risk score|% score)\\b') OR regexp_matches(t, '\\brisk(?: level)?\\s*\\(\\s*[0-9]+(?:\\.[0-9]+)?\\s*%\\s*\\)')", 4), ("'confidence'", "regexp_matches(t, '\\b[0-9]+(?:\\.[0-9]+)?\\s*%\\s*confidence\\b')", 4),
            ("'failure_probability'", "regexp_matches(t, '\\b(?:chance|probability)\\b.{0,35}\\b(?:immediate )?failure\\b')", 4),
            ("'service_interval'", "regexp_matches(t, '\\bwithin (?:the )?(?:next )?(?:few|several|couple of) (?:drive cycles|trips|days|weeks|months)\\b')", 4),
        ],
    )
)
def r03_check_description(spark, sf_dir):
    v = _sections(spark, sf_dir).select("conv_id", "turn", r.check_description(F.col("description")).alias("v"))
    return v.select("conv_id", "turn", "v.score", "v.passed", F.array_join("v.warnings", ",").alias("warnings"))


_SURE = " OR ".join(f"({_unneg_sql(p).replace('report', 'cause')})" for p in ("confirmed", "definite", "certain"))
_TOK = "regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(?:''[a-z]+)?')"
_HEDGED = " OR ".join(f"contains(t, '{p}')" for p in ("may indicate", "could suggest", "could be related to", "might", "possibly", "could be", "possible explanation"))


@query(
    f"""WITH {_SEC}, k AS (SELECT *, lower(cause) AS t, {_WORDS.format(x='cause')} AS w, {_first('cause')} AS sure, {_TOK.format(x='cause')} AS a, {_TOK.format(x='description')} AS b, {_SURE} AS told FROM sec),
m AS (SELECT *, list_has_any([array_to_string(a[i : i + 11], ' ') for i in range(1, len(a) - 10)], [array_to_string(b[i : i + 11], ' ') for i in range(1, len(b) - 10)]) AS rep FROM k), """
    + _scored_sql(
        "cause",
        [
            ("'unhedged'", f"NOT ({_HEDGED} OR ((contains(t, 'confirmed') OR contains(t, 'definite') OR contains(t, 'certain')) AND NOT told))", 2), ("'certainty:' || sure", "sure IS NOT NULL", 2), ("'repetition'", "rep", 4),
            ("'long'", "w > 130", 4), ("'short'", "w < 20", 2),
        ],
    )
)
def r04_check_cause(spark, sf_dir):
    v = _sections(spark, sf_dir).select("conv_id", "turn", r.check_cause(F.col("cause"), F.col("description")).alias("v"))
    return v.select("conv_id", "turn", "v.score", "v.passed", F.array_join("v.warnings", ",").alias("warnings"))


_EV = """ev AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Medium' WHEN 1 THEN 'High' WHEN 2 THEN NULL ELSE 'Low' END AS level, CASE WHEN event_id % 4 <> 3 THEN 'cooling_degradation' ELSE 'intake_anomaly' END AS kind,
 CAST(least(greatest(floor(value), 0), 999) AS DOUBLE) AS ct, CAST(event_id % 41 AS DOUBLE) AS rate, CAST(event_id % 61 AS DOUBLE) AS maf, CASE WHEN event_id % 6 > 0 THEN (event_id % 1001) / 1000.0 END AS p, CASE WHEN event_id % 7 > 0 THEN event_id % 12 END AS cycles, event_id % 9 = 0 AS rules FROM events)"""


@query(
    f"""WITH {_EV}, s AS (SELECT *, coalesce(ct < 90 OR ct > 105, FALSE) AS x, rate > 20 AS y, maf > 40 AS z, p * 100 AS pc FROM ev),
l AS (SELECT *, list_filter([CASE WHEN x THEN 'coolant_temp' END, CASE WHEN y THEN 'ect_rate_180s' END, CASE WHEN z THEN 'maf' END], lambda v: v IS NOT NULL) AS ab, kind = 'cooling_degradation' AND coalesce(ct < 90, FALSE) AS cold FROM s)
SELECT event_id, array_to_string(list_filter(['component ' || kind, 'risk ' || coalesce(level, 'Unknown'),
 concat_ws(' ', 'signal coolant_temp', CAST(ct AS VARCHAR), CASE WHEN ct IS NULL THEN 'UNKNOWN' WHEN x THEN 'ABNORMAL' ELSE 'NORMAL' END), 'signal ect_rate_180s ' || rate || CASE WHEN y THEN ' ABNORMAL' ELSE ' NORMAL' END, 'signal maf ' || maf || CASE WHEN z THEN ' ABNORMAL' ELSE ' NORMAL' END,
 CASE WHEN x AND y THEN 'pattern thermal_stress_pattern' WHEN len(ab) > 1 THEN 'several abnormal signals ' || array_to_string(ab, ', ') WHEN len(ab) = 1 THEN 'one abnormal signal ' || ab[1] END,
 CASE WHEN level = 'High' AND (p IS NOT NULL OR cycles IS NOT NULL) THEN 'projection withheld: risk is high now' WHEN p IS NOT NULL THEN 'chance of high risk ' || CASE WHEN p > 0 AND p < 0.01 THEN printf('%.2f', pc) WHEN pc = floor(pc) THEN CAST(CAST(pc AS INTEGER) AS VARCHAR) ELSE printf('%.1f', pc) END || '%' END,
 CASE WHEN level IS DISTINCT FROM 'High' AND (p IS NOT NULL OR cycles IS NOT NULL) THEN 'cycles to high risk ' || coalesce(CAST(cycles AS VARCHAR), 'unknown') END,
 CASE WHEN cold AND y THEN 'caution low_rising' WHEN cold THEN 'caution ambiguous' END, CASE WHEN rules THEN 'found by rules, not by the forecast' END], lambda v: v IS NOT NULL), chr(10)) AS evidence FROM l"""
)
def r13_evidence(spark, sf_dir):
    """A record an event: its value is the coolant temperature, other signals and projections vary with the id."""
    e, c = F.col("event_id"), F.col
    signal = lambda name, value, low, high: F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"), F.array(F.lit(low), F.lit(high)).alias("reference_range"))
    coolant = F.when(c("value").isNotNull(), F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(999)))
    signals = F.array(signal("coolant_temp", coolant, 90.0, 105.0), signal("ect_rate_180s", e % 41, 0.0, 20.0), signal("maf", e % 61, 0.0, 40.0))
    level = F.when(e % 5 == 0, "Medium").when(e % 5 == 1, "High").when(e % 5 > 2, "Low")
    kind = F.when(e % 4 != 3, "cooling_degradation").otherwise("intake_anomaly")
    notes = F.array(F.lit(None).cast("string"), F.when(e % 9 == 0, "decided by proxy rules").otherwise("one value repaired"))
    lines = r.evidence(kind, level, signals, F.when(e % 6 > 0, e % 1001 / 1000), F.when(e % 7 > 0, e % 12), notes, ("proxy rules",))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(lines, "\n").alias("evidence"))


_KNOW = ("No specific fault knowledge here", "An overheated engine.", "A sticking fan.\n Replace the fan. ", "Clear the fault memory.\nCheck the hose.", "No specific action guidance for it.")


@query(
    """WITH k AS (SELECT conv_id, turn, ['No specific fault knowledge here', 'An overheated engine.', 'A sticking fan.' || chr(10) || ' Replace the fan. ', 'Clear the fault memory.' || chr(10) || 'Check the hose.', 'No specific action guidance for it.'][1 + (conv_id + turn) % 5] AS add,
 text, [NULL, 'ambiguous', 'low_rising'][1 + conv_id % 3] AS pattern FROM conversations),
t AS (SELECT conv_id, turn, pattern, CASE WHEN turn % 2 = 0 THEN add ELSE concat_ws(chr(10), text, add) END AS doc FROM k)
SELECT conv_id, turn, trim(coalesce(doc, '')) <> '' AND NOT starts_with(trim(doc), 'No specific fault knowledge') AND NOT (pattern IS NOT NULL AND regexp_matches(trim(doc), '(?i)\\b(?:overheat(?:ing|ed)?|high coolant temperature|thermostat stuck closed|radiator blocked)\\b')) AS usable,
 CASE WHEN starts_with(trim(doc), 'No specific action guidance') THEN '' ELSE array_to_string(list_filter(list_transform(string_split_regex(trim(doc), '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)\\b(?:replace|replacement|clear (?:the )?(?:fault|diagnostic)|relearn|in turbo engines)\\b')), chr(10)) END AS actions FROM t"""
)
def r14_usable_docs(spark, sf_dir):
    add = _pick(_KNOW, (F.col("conv_id") + F.col("turn")) % len(_KNOW))
    doc = F.when(F.col("turn") % 2 == 0, add).otherwise(F.concat_ws("\n", "text", add))
    pattern = F.when(F.col("conv_id") % 3 == 1, "ambiguous").when(F.col("conv_id") % 3 == 2, "low_rising")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.usable_knowledge(doc, pattern).alias("usable"), F.array_join(r.owner_actions(doc), "\n").alias("actions"))


@query(
    """WITH p AS (SELECT event_id, event_type || '-' || CAST(user_id AS VARCHAR) AS segment_id FROM events WHERE value IS NOT NULL AND event_id % 10 <> 0),
s AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) AS place FROM (SELECT DISTINCT segment_id FROM p))
SELECT event_id, segment_id, CASE WHEN place % 3 = 0 THEN 'hold_out' ELSE 'calibration' END AS part FROM p JOIN s USING (segment_id)"""
)
def p13_primary_records(spark, sf_dir):
    """A record an event: without a value it is an error; every tenth is of a secondary role; a type of a user is a segment."""
    records = table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws("-", "event_type", "user_id").alias("segment_id"), F.when(F.col("value").isNull(), "no value").alias("error"), F.when(F.col("event_id") % 10 == 0, "secondary").otherwise("primary").alias("evaluation_role")
    )
    return r.primary_records(records).select("event_id", "segment_id", "part")


_ACTS = ("Have the cooling system checked soon by a garage that you trust.", "Monitor the gauge.", "Avoid long drives in the heat until the car has been seen.", "Schedule a visit at the next service, when convenient for you and them.", "Watch out for steam, smells and lamps on the way to work.")
_ACT_SQL = "[" + ", ".join(f"'{x}'" for x in _ACTS) + "]"
_any = lambda x, phrases: "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"
_unneg = lambda x, phrases: "(" + " OR ".join(f"({_unneg_sql(p).replace('report', x)})" for p in phrases) + ")"
_SURELY = ("confirmed", "is definitely", "has failed", "is broken", "is faulty", "has malfunctioned", "is damaged")
_NUMS = lambda x: f"regexp_extract_all({x}, '-?[0-9]+(?:\\.[0-9]+)?')"
_BARE = " OR ".join(
    f"(regexp_matches(both_, '\\b{x}\\b') AND NOT regexp_matches(both_, '{x}\\s*\\([^)]+\\)|\\([^)]*{x}[^)]*\\)'))" for x in ("OBD", "ECM", "PCM", "DTC", "MAF", "MAP", "TPS", "IAT")
)


@query(
    f"""WITH {_SEC}, q AS (SELECT s.conv_id, s.turn, coalesce(description, '') AS d, cause || CASE (s.conv_id + s.turn) % 4 WHEN 0 THEN ' The sensor (MAF) reads low.' WHEN 1 THEN ' The IAT reading is low: it is damaged.' ELSE '' END AS c, 'Mean 12.345 and 3 of 40 at 7 ' || text AS ctx,
 [NULL, 'High', 'Medium', 'low'][1 + s.conv_id % 4] AS level, list_slice({_ACT_SQL}, 1 + s.turn % 2, CAST((s.conv_id + s.turn) % 7 AS INTEGER)) AS acts FROM sec s JOIN conversations USING (conv_id, turn)),
p AS (SELECT *, d || ' ' || c AS both_, lower(c) AS lc, lower(array_to_string(acts, ' ')) AS told, list_filter(list_transform(string_split_regex(d, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS st FROM q),
f AS (SELECT conv_id, turn, 10 - CASE WHEN len(list_filter({_NUMS('d')}, lambda x: NOT list_contains({_NUMS('ctx')}, x))) > 0 THEN 4 ELSE 0 END - CASE WHEN {_any('lc', ('signal', 'reading', 'sensor', 'temperature', 'pressure', 'value', 'measurement'))} THEN 0 ELSE 3 END AS g,
 10 - CASE WHEN {_any('lower(both_)', ('coolant_temp', 'maf', 'map', 'accel_pedal_d', 'accel_pedal_e', 'tps', 'throttle_pos'))} THEN 3 ELSE 0 END - CASE WHEN {_BARE} THEN 3 ELSE 0 END
  - CASE WHEN coalesce(list_sum(list_transform(st, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')))), 0) > 30 * len(st) THEN 2 ELSE 0 END AS r,
 10 - CASE WHEN {_any('lc', ('may indicate', 'could suggest', 'could be related to', 'might', 'possibly', 'may be', 'could be', 'suggests', 'possible explanation'))} OR ({_any('lc', ('confirmed', 'definite', 'certain'))} AND NOT {_unneg('c', ('confirmed', 'definite', 'certain'))}) THEN 0 ELSE 4 END
  - CASE WHEN {_unneg('c', _SURELY)} OR {_unneg('d', _SURELY)} THEN 4 ELSE 0 END - CASE WHEN {_unneg('d', ('the fault is', 'the problem is', 'has failed', 'is broken', 'is faulty'))} THEN 2 ELSE 0 END AS h,
 10 - CASE WHEN len(acts) < 2 THEN 3 WHEN len(acts) > 4 THEN 2 ELSE 0 END - CASE WHEN len(list_filter(acts, lambda x: len(string_split(x, ' ')) < 10)) > 0 THEN 3 ELSE 0 END
  - CASE WHEN coalesce(CASE lower(level) WHEN 'high' THEN {_any('told', ('soon', 'prompt', 'immediately', 'avoid', 'urgent'))} WHEN 'medium' THEN {_any('told', ('soon', 'check', 'inspect', 'schedule'))} WHEN 'low' THEN {_any('told', ('monitor', 'next service', 'when convenient', 'observe'))} END, FALSE) THEN 0 ELSE 3 END AS a FROM p)
SELECT conv_id, turn, CAST(g / 10 AS DOUBLE) AS grounding, CAST(r / 10 AS DOUBLE) AS readability, CAST(h / 10 AS DOUBLE) AS hedging, CAST(a / 10 AS DOUBLE) AS actionability, CAST((g + r + h + a) / 40 AS DOUBLE) AS mean FROM f"""
)
def r08_report_quality(spark, sf_dir):
    """Sections of a turn, with actions and risk that vary, against its text."""
    k = F.col("conv_id") + F.col("turn")
    more = F.when(k % 4 == 0, " The sensor (MAF) reads low.").when(k % 4 == 1, " The IAT reading is low: it is damaged.").otherwise("")
    first, last = F.col("turn") % 2, k % 7
    acts = F.slice(F.array(*[F.lit(x) for x in _ACTS]), (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    level = F.when(F.col("conv_id") % 4 == 1, "High").when(F.col("conv_id") % 4 == 2, "Medium").when(F.col("conv_id") % 4 == 3, "low")
    context = F.concat(F.lit("Mean 12.345 and 3 of 40 at 7 "), "text")
    v = _sections(spark, sf_dir, "text").select("conv_id", "turn", r.report_quality(F.col("description"), F.concat("cause", more), acts, context, level).alias("v"))
    return v.select("conv_id", "turn", "v.*")
