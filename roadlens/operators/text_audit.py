"""Checks of report texts and retrieval over plain tables, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word lists of the checks.
NEGATIONS = ("no", "not", "never", "without", "unconfirmed")
PSEUDO = ("no doubt", "without doubt", "without question", "no question")
HEDGES = ("may", "might", "could", "possibly", "suggests", "appears", "likely")
CERTAIN = ("definitely", "certainly", "confirmed", "has failed", "is broken", "guaranteed")
URGENT = ("immediately", "stop driving", "at once", "urgent")
CLAUSE = r"[.,;:]|\bbut\b|\bhowever\b|\balthough\b"


def _escape(phrase: str) -> str:
    return "".join(f"\\{c}" if c in ".^$*+?()[]{}|\\" else c for c in phrase)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` once: where it stands in a lambda, or several times, it would be worked out for each element or place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _clauses(text: Column) -> Column:
    t = F.lower(text)
    for p in PSEUDO:
        t = F.regexp_replace(t, _escape(p), " " * len(p))
    return F.split(t, CLAUSE)


def _unnegated_in(clauses: Column, phrase: str) -> Column:
    negated = rf"\b({'|'.join(NEGATIONS)})\b|n['’]t\b"
    before = lambda clause: F.substring_index(F.regexp_replace(clause, rf"\b{_escape(phrase)}\b", "\x01"), "\x01", 1)
    return F.coalesce(F.exists(clauses, lambda c: F.contains(c, F.lit(phrase)) & c.rlike(rf"\b{_escape(phrase)}\b") & ~before(c).rlike(negated)), F.lit(False))


def has_unnegated(text: Column, phrase: str) -> Column:
    """The phrase stands in a clause without a negation word before it; phrases such as "no doubt" are no negations."""
    return _unnegated_in(_clauses(text), phrase)


def unnegated(text: Column, phrases: tuple[str, ...]) -> Column:
    return let(_clauses(text), lambda clauses: F.array_compact(F.array(*[F.when(_unnegated_in(clauses, p), p) for p in phrases])))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), "")


def shared_shingle(a: Column, b: Column, n: int = 12, words: Callable[[Column], Column] = word_list) -> Column:
    """The texts share n words in a row; ``words`` tells those of a text."""
    shingles = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.arrays_overlap(let(words(a), shingles), let(words(b), shingles))


def numbers(text: Column) -> Column:
    """Numbers as they are written, signs included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), 0)


def unsupported_numbers(claim: Column, context: Column) -> Column:
    return F.array_sort(F.array_except(numbers(claim), numbers(context)))


def sentences(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), "")


def text_stats(text: Column) -> Column:
    """Struct of words, sentences and words a sentence."""
    w = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")
    s = F.size(sentences(text)).cast("long")
    return F.struct(w.alias("words"), s.alias("sentences"), F.when(s > 0, w / s).alias("words_a_sentence"))


def check_text(text: Column, context: Column, low: int, high: int) -> Column:
    """Struct of a score from 1 down, by deductions, and the warnings that explain it."""
    words = text_stats(text)["words"]
    tests = [
        ("length", ~words.between(low, high), 0.2),
        ("raw_field", text.rlike(r"\b[a-z]+_[a-z_]+\b"), 0.2),
        ("certainty", F.size(unnegated(text, CERTAIN)) > 0, 0.3),
        ("precision", text.rlike(r"[0-9]+\.[0-9]{3,}"), 0.1),
        ("unsupported_number", F.size(unsupported_numbers(text, context)) > 0, 0.2),
    ]
    yes = lambda t: F.coalesce(t, F.lit(False))
    lost = sum((F.when(yes(t), w).otherwise(0.0) for _, t, w in tests), F.lit(0.0))
    return F.struct(F.round(F.greatest(F.lit(0.0), 1 - lost), 4).alias("score"), F.array_join(F.array_compact(F.array(*[F.when(yes(t), n) for n, t, _ in tests])), ",").alias("warnings"))


def quality_score(text: Column, context: Column) -> Column:
    """Struct of grounding, readability, hedging and actionability, each 0 to 1, and their mean."""
    stats = text_stats(text)
    n = F.size(numbers(text))
    grounding = F.when(n == 0, 1.0).otherwise(1 - F.size(unsupported_numbers(text, context)) / n)
    wps = F.coalesce(stats["words_a_sentence"], F.lit(0.0))
    readability = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (wps - 20) / 20))
    hedging = F.when(F.size(unnegated(text, CERTAIN)) > 0, 0.0).when(F.lower(text).rlike(rf"\b({'|'.join(HEDGES)})\b"), 1.0).otherwise(0.5)
    action = F.when(F.lower(text).rlike(r"\b(check|inspect|replace|visit|monitor|schedule)\b"), 1.0).otherwise(0.0)
    parts = {"grounding": grounding, "readability": readability, "hedging": hedging, "actionability": action}
    return F.struct(*[F.round(v, 4).alias(c) for c, v in parts.items()], F.round(sum(parts.values(), F.lit(0.0)) / 4, 4).alias("mean"))


def redact(text: Column) -> Column:
    """Trouble codes, rule ids and file names taken out, white space tidied."""
    t = F.regexp_replace(text, r"\b[PBCU][0-9][0-9A-F]{3}\b", "a fault code")
    t = F.regexp_replace(t, r"\b[1-5]-S[1-4][ab]?\b", "a check")
    t = F.regexp_replace(t, r"\b[\w-]+\.(csv|json|parquet|py)\b", "a data file")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^ | $", "")


def drop_sentences(text: Column, pattern: str) -> Column:
    """Sentences that match are left out; the text stays as it is if none would remain."""
    kept = F.filter(sentences(text), lambda s: ~F.lower(s).rlike(pattern))
    return F.when(F.size(kept) == 0, text).otherwise(F.concat(F.array_join(kept, ". "), F.lit(".")))


def perturb(text: Column) -> Column:
    """A variant of the same meaning: synonyms and punctuation changed."""
    t = F.regexp_replace(text, r"\bcheck\b", "inspect")
    t = F.regexp_replace(t, r"\bthe\b", "this")
    return F.regexp_replace(t, r"\.(\s|$)", "!$1")


def projection_text(probability: Column, cycles: Column, level: Column) -> Column:
    p = F.when(probability.isNull(), "No projection is available yet.").otherwise(F.concat(F.lit("Chance of reaching high risk in ten trips: "), F.round(probability * 100, 0).cast("int").cast("string"), F.lit("%.")))
    c = F.when(cycles == 0, "The risk is high now.").when(cycles.isNotNull(), F.concat(F.lit("At this rate, in "), cycles.cast("string"), F.lit(" trips.")))
    return F.concat_ws(" ", p, c, F.when(level == "High", "Have the car checked soon."))


def lookup_docs(queries: DataFrame, docs: DataFrame, fallback: str, broadcast_rows: int = 10_000) -> DataFrame:
    """Exact lookup by (type, section, level lower-cased), else by type and section without a level, else the fallback. ``docs`` hold a key once; up to ``broadcast_rows`` of them are broadcast."""
    side = F.broadcast if docs.count() <= broadcast_rows else lambda df: df
    exact = docs.select(F.col("type").alias("_t"), F.col("section").alias("_s"), F.lower("level").alias("_l"), F.col("content").alias("exact"))
    loose = docs.where("level is null").select(F.col("type").alias("_t2"), F.col("section").alias("_s2"), F.col("content").alias("loose"))
    q = queries.join(side(exact), (F.col("type") == F.col("_t")) & (F.col("section") == F.col("_s")) & (F.lower("level") == F.col("_l")), "left")
    q = q.join(side(loose), (F.col("type") == F.col("_t2")) & (F.col("section") == F.col("_s2")), "left")
    return q.select(*queries.columns, F.coalesce("exact", "loose", F.lit(fallback)).alias("content"))


def semantic_top1(queries: DataFrame, docs: DataFrame, broadcast_rows: int = 100_000, cells: int = 4_000_000) -> DataFrame:
    """For each query vector (q_id, q_v), the most similar document (d_id, d_v) by cosine; the smaller id on a tie.

    ``queries`` is a stated set, sent to all tasks in blocks of at most ``broadcast_rows``. A task multiplies a batch of
    documents with the queries, norms taken once, and keeps one winner a query; winners are pre-aggregated
    maxima, so no list of candidates is ever gathered, and a product holds at most ``cells`` numbers. Vectors without a direction match nothing.
    """
    q = queries.where("q_v is not null").select("q_id", F.col("q_v").cast("array<double>").alias("q_v"))
    blocks = max(1, -(-q.count() // broadcast_rows))
    out = None
    for part in range(blocks):
        rows = q.where(F.pmod(F.hash("q_id"), F.lit(blocks)) == part).toPandas()
        ids = rows["q_id"].to_numpy(dtype=np.int64)
        unit = _units(rows["q_v"])

        def search(batches: Iterator[pd.DataFrame], ids=ids, unit=unit) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                d_ids = batch["d_id"].to_numpy(dtype=np.int64)
                order = np.argsort(d_ids, kind="stable")
                d_ids, d_unit = d_ids[order], _units(batch["d_v"], unit.shape[1])[order]
                step = max(1, cells // len(batch))
                for s in range(0, len(ids), step):
                    own = ids[s : s + step]
                    cos = np.round(unit[s : s + step] @ d_unit.T, 9)
                    cos[(own[:, None] == d_ids) | np.isnan(cos)] = -9
                    at = cos.argmax(axis=1)
                    best = cos[np.arange(len(own)), at]
                    yield pd.DataFrame({"q_id": own, "d_id": d_ids[at], "cos": best})[best > -9]

        found = docs.where("d_v is not null").select("d_id", F.col("d_v").cast("array<double>").alias("d_v")).mapInPandas(search, "q_id long, d_id long, cos double")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("q_id").agg(F.max(F.struct("cos", (-F.col("d_id")).alias("d"))).alias("b"))
    return best.select("q_id", (-F.col("b.d")).alias("d_id"), F.round("b.cos", 6).alias("cos"))


def _units(vectors: pd.Series, size: int | None = None) -> np.ndarray:
    """Unit rows; those of another length than ``size``, or the first one's, and without a direction are not numbers."""
    size = size or (len(vectors.iloc[0]) if len(vectors) else 0)
    x = np.array([v if len(v) == size else [np.nan] * size for v in vectors], dtype=np.float64).reshape(len(vectors), size)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stability(scores: DataFrame) -> DataFrame:
    """Share of (report, variant, dimension) whose score is that of the original, per variant."""
    w = Window.partitionBy("report", "dimension")
    s = scores.withColumn("original", F.max(F.when(F.col("variant") == "original", F.col("score"))).over(w)).where("variant <> 'original'")
    return s.groupBy("variant").agg(F.avg((F.col("score") == F.col("original")).cast("double")).alias("unchanged"), F.count("*").alias("n"))


ACTION_VERBS = ("check", "inspect", "replace", "visit", "monitor", "schedule", "clean", "have")
UNSAFE = ("ignore", "keep driving", "disconnect the battery", "bypass")


def clean_actions(actions: Column, most: int = 4) -> Column:
    """Action items trimmed, opened with a capital, closed with one full stop; empty and repeated ones left out, at most ``most``."""
    tidy = F.transform(actions, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s\-*0-9.)]+", ""), r"[\s.!]+$", ""))
    shaped = F.transform(F.array_remove(F.array_compact(tidy), ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100_000), F.lit(".")))
    return F.slice(F.array_distinct(shaped), 1, most)


def check_actions(actions: Column, level: Column, wanted: int = 4) -> Column:
    """Struct of a score and warnings: number of items, items that open with no known verb, urgency that does not fit the level."""
    starts = rf"^({'|'.join(ACTION_VERBS)})\b"
    urgent = F.exists(actions, lambda x: F.lower(x).rlike(rf"\b({'|'.join(URGENT)})\b"))
    tests = [
        ("count", F.size(actions) != wanted, 0.3),
        ("prefix", F.exists(actions, lambda x: ~F.lower(x).rlike(starts)), 0.2),
        ("panic", urgent & (level == "Low"), 0.3),
        ("not_urgent", ~urgent & (level == "High"), 0.2),
    ]
    yes = lambda t: F.coalesce(t, F.lit(False))
    lost = sum((F.when(yes(t), w).otherwise(0.0) for _, t, w in tests), F.lit(0.0))
    return F.struct(F.round(F.greatest(F.lit(0.0), 1 - lost), 4).alias("score"), F.array_join(F.array_compact(F.array(*[F.when(yes(t), n) for n, t, _ in tests])), ",").alias("warnings"))


def auto_audit(text: Column, context: Column) -> Column:
    """Findings of a report, joined: numbers without support, raw field names, unsafe advice that is not negated."""
    found = F.array_compact(
        F.array(
            F.when(F.size(unsupported_numbers(text, context)) > 0, "unsupported_number"),
            F.when(text.rlike(r"\b[a-z]+_[a-z_]+\b"), "raw_field"),
            *[F.when(has_unnegated(text, p), F.concat(F.lit("unsafe:"), F.lit(p))) for p in UNSAFE],
        )
    )
    return F.array_join(found, ",")


# Patterns of the policy on what a report may claim.
FUTURE_HIGH = (
    r"\b(?:will|may|could|expected to|projected to)\b.{0,50}\b(?:reach|cross|enter)\b.{0,25}\bhigh(?:-risk| risk)?\b",
    r"\bhigh(?:-risk| risk)?(?: threshold)?\b.{0,35}\b(?:within|in|after|around)\b.{0,20}\b(?:trip|drive cycle)s?\b",
    r"\b(?:reach|cross(?:ing)?(?: into)?|enter)\b.{0,30}\bhigh(?:-risk| risk)?\b.{0,35}\b(?:trip|drive cycle)s?\b",
)
OVERSTATED = ("prompt", "urgent", "immediate")
COOLANT_HIGH = r"(?:coolant temperature.{0,45}(?:higher|above|elevated)|(?:high|elevated) coolant temperature)"
COOLANT_LOW = r"coolant temperature.{0,45}(?:lower|below)"
ALL_WELL = r"(?:\b(?:system|component|sensor|vehicle)\b.{0,35}\b(?:operat(?:es|ing)|function(?:s|ing))\b.{0,12}\b(?:normally|as expected|within expected limits|correctly|adequately)\b)"
FAULT_CLAIM = (r"\b(?:high-risk\s+)?fault\b", r"\bstrongly suggest(?:s|ing)?\b.{0,45}\b(?:sensor|mechanical)\b")
STOP_PREFIX, PEDAL = "stop driving and seek help if:", r"\bpedals?\b|\bpedal response\b"
PENALTY = 0.4


def policy_check(text: Column, risk_level: Column, anomaly_type: Column, signals: Column, proxied: Column, actions: Column | None = None) -> Column:
    """Struct (score, passed, warnings) of what a report may not claim, given its record.

    ``signals`` is an array of (feature, value, reference_range); ``proxied`` tells that rules, not the forecast, decided;
    ``actions`` is an array of texts. Warnings, in order: a crossing into high risk that is foretold although it has come,
    urgency that medium risk does not bear, a coolant temperature on the other side of its range, a whole system that works
    because the listed signals do, a fault that rules with normal signals cannot prove, and a stopping condition of
    another component. Each takes 0.4 off the score, and any of them fails the text. A null text claims nothing.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    low, high = (lambda s: F.get(s["reference_range"], F.lit(0))), (lambda s: F.get(s["reference_range"], F.lit(1)))
    coolant = lambda side: yes(F.exists(signals, lambda s: yes((s["feature"] == "coolant_temp") & side(s))))
    normal = yes(F.size(signals) > 0) & yes(F.forall(signals, lambda s: yes(s["value"].between(low(s), high(s)))))
    foretold = t.rlike(FUTURE_HIGH[0]) | t.rlike(FUTURE_HIGH[1]) | t.rlike(FUTURE_HIGH[2])
    urgent = F.size(unnegated(t, OVERSTATED)) > 0
    found = [
        ("future_high", yes(F.lower(risk_level) == "high") & foretold),
        ("urgency", yes(risk_level == "Medium") & urgent),
        ("reversed_signal", (coolant(lambda s: s["value"] < low(s)) & t.rlike(COOLANT_HIGH)) | (coolant(lambda s: s["value"] > high(s)) & t.rlike(COOLANT_LOW))),
        ("system_normal", normal & t.rlike(ALL_WELL)),
        ("unproved_fault", yes(proxied) & normal & (t.rlike(FAULT_CLAIM[0]) | t.rlike(FAULT_CLAIM[1]))),
    ]
    if actions is not None:
        stops = F.exists(actions, lambda x: yes(F.startswith(F.lower(F.trim(x)), F.lit(STOP_PREFIX)) & F.lower(x).rlike(PEDAL)))
        found.append(("foreign_stop", yes(~anomaly_type.eqNullSafe(F.lit("accelerator_pedal_sensor"))) & yes(stops)))
    told = F.array_compact(F.array(*[F.when(c, n) for n, c in found]))
    return F.struct(F.greatest(F.lit(0.0), F.round(1 - PENALTY * F.size(told), 4)).alias("score"), (F.size(told) == 0).alias("passed"), told.alias("warnings"))
