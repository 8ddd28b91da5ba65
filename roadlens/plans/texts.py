"""Queries of report-text audit and retrieval (R-*, J-14, J-15, X-26, X-27, U-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlens.operators import text_audit as a
from roadlens.plans.registry import query
from roadlens.sources.adapters import table


def _reports(spark, sf_dir):
    """Reports made from conversations: the whole text of a turn, with phrases of the checks after it."""
    add = F.element_at(F.array(*[F.lit(x) for x in ADDED]), (F.col("conv_id") % len(ADDED) + 1).cast("int"))
    context = F.concat(F.lit("Mean 12.5 and 3 of 40 at 95 "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", add).alias("report"), context.alias("context"))


ADDED = (
    "There is no confirmed fault.", "No doubt it has failed.", "This is not notable, but it has failed: check the P0101 code.", "It may be the sensor at 12.5 V.", "The maf_residual was 3.14159, definitely.",
    "It isn't confirmed. Inspect the hose, see log.csv, rule 2-S2.", "Visit a garage at once; 40 of 95.", "Normal. Nothing to do.",
)
_REP = (
    "rep AS (SELECT conv_id, turn, concat_ws(' ', body, ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in ADDED) + f"])[1 + conv_id % {len(ADDED)}]) AS report, 'Mean 12.5 and 3 of 40 at 95 ' || body AS context"
    " FROM (SELECT conv_id, turn, text AS body FROM conversations))"
)


def _unneg_sql(phrase: str) -> str:
    masked = "lower(report)"
    for p in a.PSEUDO:
        masked = f"replace({masked}, '{p}', '{' ' * len(p)}')"
    clauses = f"string_split_regex({masked}, '[.,;:]|\\bbut\\b|\\bhowever\\b|\\balthough\\b')"
    negated = f"regexp_matches(split_part(regexp_replace(c, '\\b{phrase}\\b', chr(1)), chr(1), 1), '\\b({'|'.join(a.NEGATIONS)})\\b|n[''’]t\\b')"
    return f"len(list_filter({clauses}, lambda c: regexp_matches(c, '\\b{phrase}\\b') AND NOT {negated})) > 0"


@query(f"WITH {_REP} SELECT conv_id, turn, " + ", ".join(f"{_unneg_sql(p)} AS {p.replace(' ', '_')}" for p in ("confirmed", "has failed", "definitely")) + " FROM rep")
def r01_unnegated(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "turn", *[a.has_unnegated(F.col("report"), p).alias(p.replace(" ", "_")) for p in ("confirmed", "has failed", "definitely")])


_NUM = lambda c: f"regexp_extract_all({c}, '-?[0-9]+(?:\\.[0-9]+)?')"
_TOK = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


@query(
    f"WITH {_REP}, w AS (SELECT conv_id, turn, {_TOK('report')} AS a, {_TOK('context')} AS b FROM rep), s AS (SELECT conv_id, turn, [array_to_string(a[i : i + 11], ' ') for i in range(1, len(a) - 10)] AS sa, [array_to_string(b[i : i + 11], ' ') for i in range(1, len(b) - 10)] AS sb FROM w) SELECT conv_id, turn, list_has_any(sa, sb) AS shared FROM s"
)
def r02_shared_shingle(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "turn", a.shared_shingle(F.col("report"), F.col("context")).alias("shared"))


@query(
    f"WITH {_REP} SELECT conv_id, turn, array_to_string({_NUM('report')}, ' ') AS numbers, array_to_string(list_sort(list_filter(list_distinct({_NUM('report')}), lambda x: NOT list_contains({_NUM('context')}, x))), ' ') AS unsupported FROM rep"
)
def x27_u03_numbers(spark, sf_dir):
    r = F.col("report")
    return _reports(spark, sf_dir).select("conv_id", "turn", F.array_join(a.numbers(r), " ").alias("numbers"), F.array_join(a.unsupported_numbers(r, F.col("context")), " ").alias("unsupported"))


_STAT = """st AS (SELECT conv_id, turn, report, context, CAST(len(list_filter(string_split_regex(report, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(len(list_filter(list_transform(string_split_regex(report, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS BIGINT) AS sentences FROM rep)"""


@query(f"WITH {_REP}, {_STAT} SELECT conv_id, turn, words, sentences, round(words / sentences, 6) AS words_a_sentence FROM st")
def x26_text_stats(spark, sf_dir):
    s = _reports(spark, sf_dir).select("conv_id", "turn", a.text_stats(F.col("report")).alias("s"))
    return s.select("conv_id", "turn", "s.words", "s.sentences", F.round("s.words_a_sentence", 6).alias("words_a_sentence"))


_CERT = " OR ".join(f"({_unneg_sql(p)})" for p in a.CERTAIN)
_UNSUP = f"len(list_filter(list_distinct({_NUM('report')}), lambda x: NOT list_contains({_NUM('context')}, x)))"


@query(
    f"""WITH {_REP}, {_STAT}, c AS (SELECT conv_id, turn, words NOT BETWEEN 20 AND 35 AS a, regexp_matches(report, '\\b[a-z]+_[a-z_]+\\b') AS b, ({_CERT}) AS c, regexp_matches(report, '[0-9]+\\.[0-9]{{3,}}') AS d, {_UNSUP} > 0 AS e FROM st)
SELECT conv_id, turn, round(greatest(0, 1 - (CASE WHEN a THEN 0.2 ELSE 0.0 END + CASE WHEN b THEN 0.2 ELSE 0.0 END + CASE WHEN c THEN 0.3 ELSE 0.0 END + CASE WHEN d THEN 0.1 ELSE 0.0 END + CASE WHEN e THEN 0.2 ELSE 0.0 END)), 4)::DOUBLE AS score,
 concat_ws(',', CASE WHEN a THEN 'length' END, CASE WHEN b THEN 'raw_field' END, CASE WHEN c THEN 'certainty' END, CASE WHEN d THEN 'precision' END, CASE WHEN e THEN 'unsupported_number' END) AS warnings FROM c"""
)
def r03_r04_check_text(spark, sf_dir):
    s = _reports(spark, sf_dir).select("conv_id", "turn", a.check_text(F.col("report"), F.col("context"), 20, 35).alias("c"))
    return s.select("conv_id", "turn", "c.score", "c.warnings")


@query(
    f"""WITH {_REP}, {_STAT}, q AS (SELECT conv_id, turn, CASE WHEN len({_NUM('report')}) = 0 THEN 1 ELSE 1 - {_UNSUP} / len({_NUM('report')}) END AS grounding,
 greatest(0, least(1, 1 - (coalesce(words / sentences, 0) - 20) / 20)) AS readability, CASE WHEN {_CERT} THEN 0.0 WHEN regexp_matches(lower(report), '\\b({'|'.join(a.HEDGES)})\\b') THEN 1.0 ELSE 0.5 END AS hedging,
 CASE WHEN regexp_matches(lower(report), '\\b(check|inspect|replace|visit|monitor|schedule)\\b') THEN 1.0 ELSE 0.0 END AS actionability FROM st)
SELECT conv_id, turn, round(grounding, 4)::DOUBLE AS grounding, round(readability, 4)::DOUBLE AS readability, hedging::DOUBLE AS hedging, actionability::DOUBLE AS actionability, round((grounding + readability + hedging::DOUBLE + actionability::DOUBLE) / 4, 4)::DOUBLE AS mean FROM q"""
)
def r08_quality_score(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "turn", a.quality_score(F.col("report"), F.col("context")).alias("q")).select("conv_id", "turn", "q.*")


@query(
    f"""WITH {_REP} SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(report, '\\b[PBCU][0-9][0-9A-F]{{3}}\\b', 'a fault code', 'g'), '\\b[1-5]-S[1-4][ab]?\\b', 'a check', 'g'), '\\b[\\w-]+\\.(csv|json|parquet|py)\\b', 'a data file', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS clean FROM rep"""
)
def r10_redact(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "turn", a.redact(F.col("report")).alias("clean"))


@query(
    f"""WITH {_REP}, s AS (SELECT conv_id, turn, report, list_filter(list_filter(list_transform(string_split_regex(report, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), lambda x: NOT regexp_matches(lower(x), 'failed|confirmed|garage')) AS k FROM rep)
SELECT conv_id, turn, CASE WHEN len(k) = 0 THEN report ELSE array_to_string(k, '. ') || '.' END AS kept FROM s"""
)
def r11_drop_sentences(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "turn", a.drop_sentences(F.col("report"), "failed|confirmed|garage").alias("kept"))


@query(f"WITH {_REP} SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(report, '\\bcheck\\b', 'inspect', 'g'), '\\bthe\\b', 'this', 'g'), '\\.(\\s|$)', '!\\1', 'g') AS variant FROM rep")
def r16_perturb(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "turn", a.perturb(F.col("report")).alias("variant"))


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 101) / 100.0 END AS p, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 9 END AS c, CASE WHEN o_totalprice > 250000 THEN 'High' ELSE 'Low' END AS l FROM orders)
SELECT o_orderkey, concat_ws(' ', CASE WHEN p IS NULL THEN 'No projection is available yet.' ELSE 'Chance of reaching high risk in ten trips: ' || CAST(CAST(round(p * 100, 0) AS INTEGER) AS VARCHAR) || '%.' END,
 CASE WHEN c = 0 THEN 'The risk is high now.' WHEN c IS NOT NULL THEN 'At this rate, in ' || c || ' trips.' END, CASE WHEN l = 'High' THEN 'Have the car checked soon.' END) AS text FROM o"""
)
def r17_projection_text(spark, sf_dir):
    k = F.col("o_orderkey")
    level = F.when(F.col("o_totalprice") > 250000, "High").otherwise("Low")
    return table(spark, sf_dir, "orders").select("o_orderkey", a.projection_text(F.when(k % 6 != 0, k % 101 / 100.0), F.when(k % 4 != 0, k % 9), level).alias("text"))


_DOCS = "kd AS (SELECT item_id, 'type' || (item_id % 4) AS type, 'section' || (item_id % 3) AS section, CASE item_id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' END AS level, text AS content FROM benchmark)"
_DOCU = "ku AS (SELECT type, section, level, min(content) AS content FROM kd GROUP BY ALL)"


@query(
    f"""WITH {_DOCS}, {_DOCU}, q AS (SELECT o_orderkey, 'type' || (o_orderkey % 5) AS type, 'section' || (o_custkey % 3) AS section, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'LOW' ELSE 'Medium' END AS level FROM orders)
SELECT q.o_orderkey, coalesce(e.content, l.content, 'no entry') AS content FROM q LEFT JOIN ku e ON e.type = q.type AND e.section = q.section AND lower(e.level) = lower(q.level) LEFT JOIN ku l ON l.type = q.type AND l.section = q.section AND l.level IS NULL"""
)
def j14_s15_lookup_docs(spark, sf_dir):
    i = F.col("item_id")
    tag = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    level = F.when(i % 5 == 0, "High").when(i % 5 == 1, "Low").when(i % 5 == 2, "Medium")
    docs = table(spark, sf_dir, "benchmark").select(tag("type", i % 4).alias("type"), tag("section", i % 3).alias("section"), level.alias("level"), F.col("text").alias("content"))
    docs = docs.groupBy("type", "section", "level").agg(F.min("content").alias("content"))
    k = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select("o_orderkey", tag("type", k % 5).alias("type"), tag("section", F.col("o_custkey") % 3).alias("section"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "LOW").otherwise("Medium").alias("level"))
    return a.lookup_docs(q, docs, "no entry").select("o_orderkey", "content")


_TOP = """q AS (SELECT vec_id AS q_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT q_id, vec_id, round(list_cosine_similarity(v, CAST(embedding AS DOUBLE[])), 9) AS cos FROM q, embeddings WHERE vec_id <> q_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, vec_id) AS k FROM c)"""


@query(f"WITH {_TOP} SELECT q_id, vec_id AS d_id, round(cos, 6) AS cos FROM k WHERE k = 1")
def j15_semantic_top1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_v"))
    return a.semantic_top1(q, e.select(F.col("vec_id").alias("d_id"), F.col("embedding").alias("d_v")))


@query(f"WITH {_TOP}, m AS (SELECT q_id, b.label = a.label AS correct FROM k JOIN embeddings a ON a.vec_id = q_id JOIN embeddings b ON b.vec_id = k.vec_id WHERE k = 1) SELECT count(*) AS queries, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy FROM m")
def r15_compare_retrieval(spark, sf_dir):
    top = j15_semantic_top1(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    j = top.join(e.select(F.col("vec_id").alias("q_id"), F.col("label").alias("a")), "q_id").join(e.select(F.col("vec_id").alias("d_id"), F.col("label").alias("b")), "d_id")
    return j.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("accuracy"))


_ACT = """ac AS (SELECT conv_id, turn, report, context, list_filter(list_transform(string_split_regex(report, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS acts, CASE conv_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS level FROM rep)"""


def _actions(spark, sf_dir):
    level = F.element_at(F.array(*[F.lit(x) for x in ("High", "Medium", "Low")]), (F.col("conv_id") % 3 + 1).cast("int"))
    return _reports(spark, sf_dir).withColumns({"acts": a.sentences(F.col("report")), "level": level})


@query(
    f"""WITH {_REP}, {_ACT}, t AS (SELECT conv_id, turn, list_transform(list_filter(list_transform(acts, lambda x: regexp_replace(regexp_replace(x, '^[\\s\\-*0-9.)]+', ''), '[\\s.!]+$', '')), lambda x: x <> ''), lambda x: upper(substr(x, 1, 1)) || substr(x, 2) || '.') AS s FROM ac),
u AS (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM t), d AS (SELECT conv_id, turn, s[i] AS x, min(i) AS i FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM d),
g AS (SELECT conv_id, turn, string_agg(x, '|' ORDER BY i) FILTER (n <= 4) AS actions FROM k GROUP BY ALL)
SELECT conv_id, turn, coalesce(actions, '') AS actions FROM rep LEFT JOIN g USING (conv_id, turn)"""
)
def r12_clean_actions(spark, sf_dir):
    return _actions(spark, sf_dir).select("conv_id", "turn", F.array_join(a.clean_actions(F.col("acts")), "|").alias("actions"))


@query(
    f"""WITH {_REP}, {_ACT}, c AS (SELECT conv_id, turn, len(acts) <> 4 AS a, len(list_filter(acts, lambda x: NOT regexp_matches(lower(x), '^({'|'.join(a.ACTION_VERBS)})\\b'))) > 0 AS b,
 len(list_filter(acts, lambda x: regexp_matches(lower(x), '\\b({'|'.join(a.URGENT)})\\b'))) > 0 AS u, level FROM ac)
SELECT conv_id, turn, round(greatest(0, 1 - (CASE WHEN a THEN 0.3 ELSE 0.0 END + CASE WHEN b THEN 0.2 ELSE 0.0 END + CASE WHEN u AND level = 'Low' THEN 0.3 ELSE 0.0 END + CASE WHEN NOT u AND level = 'High' THEN 0.2 ELSE 0.0 END)), 4)::DOUBLE AS score,
 concat_ws(',', CASE WHEN a THEN 'count' END, CASE WHEN b THEN 'prefix' END, CASE WHEN u AND level = 'Low' THEN 'panic' END, CASE WHEN NOT u AND level = 'High' THEN 'not_urgent' END) AS warnings FROM c"""
)
def r05_check_actions(spark, sf_dir):
    return _actions(spark, sf_dir).select("conv_id", "turn", a.check_actions(F.col("acts"), F.col("level")).alias("c")).select("conv_id", "turn", "c.score", "c.warnings")


@query(
    f"WITH {_REP} SELECT conv_id, turn, concat_ws(',', CASE WHEN {_UNSUP} > 0 THEN 'unsupported_number' END, CASE WHEN regexp_matches(report, '\\b[a-z]+_[a-z_]+\\b') THEN 'raw_field' END, "
    + ", ".join(f"CASE WHEN {_unneg_sql(p)} THEN 'unsafe:{p}' END" for p in a.UNSAFE)
    + ") AS findings FROM rep"
)
def r09_auto_audit(spark, sf_dir):
    return _reports(spark, sf_dir).select("conv_id", "turn", a.auto_audit(F.col("report"), F.col("context")).alias("findings"))


_CLAIMS = (
    "It is projected to reach high risk soon.", "Have it checked; this is urgent.", "The coolant temperature is well above its range.", "The coolant temperature stays below its range.", "The system is operating normally.",
    "This strongly suggests a sensor problem.", "Not urgent at all.", "High risk within 12 trips.", "Crossing into high risk after some trips.",
)
_LEVELS, _KINDS, _COOLANT = ("High", "Medium", "Low"), ("cooling_degradation", "accelerator_pedal_sensor"), (80.0, 92.0, 99.0)
_POLICY = (
    "pc AS (SELECT conv_id, turn, lower(concat_ws(' ', text, ([" + ", ".join(f"'{x}'" for x in _CLAIMS) + f"])[1 + (conv_id + turn) % {len(_CLAIMS)}])) AS t, ([" + ", ".join(f"'{x}'" for x in _LEVELS)
    + "])[1 + conv_id % 3] AS level, (conv_id // 3) % 2 = 1 AS pedal, ([80.0, 92.0, 99.0])[1 + (conv_id // 2) % 3] AS coolant, turn % 2 = 0 AS proxied FROM conversations)"
)


@query(
    f"""WITH {_POLICY}, f AS (SELECT conv_id, turn,
 level = 'High' AND (regexp_matches(t, '\\b(?:will|may|could|expected to|projected to)\\b.{{0,50}}\\b(?:reach|cross|enter)\\b.{{0,25}}\\bhigh(?:-risk| risk)?\\b') OR regexp_matches(t, '\\bhigh(?:-risk| risk)?(?: threshold)?\\b.{{0,35}}\\b(?:within|in|after|around)\\b.{{0,20}}\\b(?:trip|drive cycle)s?\\b')
  OR regexp_matches(t, '\\b(?:reach|cross(?:ing)?(?: into)?|enter)\\b.{{0,30}}\\bhigh(?:-risk| risk)?\\b.{{0,35}}\\b(?:trip|drive cycle)s?\\b')) AS a,
 level = 'Medium' AND ({" OR ".join(f"({_unneg_sql(p).replace('report', 't')})" for p in ("prompt", "urgent", "immediate"))}) AS b,
 (coolant < 90 AND regexp_matches(t, '(?:coolant temperature.{{0,45}}(?:higher|above|elevated)|(?:high|elevated) coolant temperature)')) OR (coolant > 95 AND regexp_matches(t, 'coolant temperature.{{0,45}}(?:lower|below)')) AS c,
 coolant BETWEEN 90 AND 95 AND regexp_matches(t, '\\b(?:system|component|sensor|vehicle)\\b.{{0,35}}\\b(?:operat(?:es|ing)|function(?:s|ing))\\b.{{0,12}}\\b(?:normally|as expected|within expected limits|correctly|adequately)\\b') AS d,
 proxied AND coolant BETWEEN 90 AND 95 AND (regexp_matches(t, '\\b(?:high-risk\\s+)?fault\\b') OR regexp_matches(t, '\\bstrongly suggest(?:s|ing)?\\b.{{0,45}}\\b(?:sensor|mechanical)\\b')) AS e, NOT pedal AND turn % 3 = 1 AS g FROM pc)
SELECT conv_id, turn, CAST(round(greatest(0, 1 - 0.4 * (CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) + CAST(e AS INTEGER) + CAST(g AS INTEGER))), 4) AS DOUBLE) AS score, NOT (a OR b OR c OR d OR e OR g) AS passed,
 concat_ws(',', CASE WHEN a THEN 'future_high' END, CASE WHEN b THEN 'urgency' END, CASE WHEN c THEN 'reversed_signal' END, CASE WHEN d THEN 'system_normal' END, CASE WHEN e THEN 'unproved_fault' END, CASE WHEN g THEN 'foreign_stop' END) AS warnings FROM f"""
)
def r06_r07_policy_check(spark, sf_dir):
    """Whole texts of conversations with a claim after each, against records whose level, type, coolant and provenance vary."""
    c = F.col
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at + 1).cast("int"))
    third, half = F.floor(c("conv_id") / 3) % 2, F.floor(c("conv_id") / 2) % 3
    df = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat_ws(" ", "text", pick(_CLAIMS, (c("conv_id") + c("turn")) % len(_CLAIMS))).alias("t"), pick(_LEVELS, c("conv_id") % 3).alias("level"), pick(_KINDS, third).alias("kind"),
        F.array(F.struct(F.lit("coolant_temp").alias("feature"), pick(_COOLANT, half).alias("value"), F.array(F.lit(90.0), F.lit(95.0)).alias("reference_range"))).alias("signals"),
        F.array(F.when(c("turn") % 3 == 1, "Stop driving and seek help if: the pedals stick.").otherwise("Check the pedals.")).alias("actions"), (c("turn") % 2 == 0).alias("proxied"),
    )
    v = a.policy_check(c("t"), c("level"), c("kind"), c("signals"), c("proxied"), c("actions"))
    return df.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.score", "v.passed", F.array_join("v.warnings", ",").alias("warnings"))
