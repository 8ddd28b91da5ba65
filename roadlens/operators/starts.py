"""Engine starts: episodes, cold-start evidence of a segment's first row, warm-up evidence and their decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.operators.continuity import KEYS, back, local_blocks, ok, quality_valid, segment_window, true_runs
from roadlens.operators.rolling import segment_gaps


def valid_in(df: DataFrame, *signals: str) -> Column:
    """All of the signals are quality valid, in a table with their flags or one of ``with_quality``."""
    return ok(signals) if f"{signals[0]}_ok" in df.columns else quality_valid(signals)


def start_episodes(df: DataFrame) -> DataFrame:
    """One row per engine-start episode.

    An episode runs from a sample at which the engine turns on inside a block of valid engine speed to
    the end of that on-run. What ends it follows from the next row of the table in time order: an
    invalid one, a row of another block, engine speed below 50, or none. Where a segment ends, that next
    row is the first of the segment that comes next, found in a table of a row per segment.
    """
    valid = valid_in(df, "rpm")
    df = local_blocks(df, valid, "block").withColumn("on", F.col("block").isNotNull() & (F.col("rpm") >= k.ENGINE_ON_RPM))
    df = true_runs(df.withColumn("edge", F.col("on") & (back("on") == F.lit(False))), F.col("on"))
    df = df.withColumn("next", F.lead(F.struct("block", F.col("block").isNotNull().alias("ok"))).over(segment_window()))
    first = F.min_by(F.col("block").isNotNull(), "row_in_segment").alias("first_ok")
    order = Window.orderBy("start", "trip_id", "segment_id")  # a row a segment
    segments = df.groupBy("trip_id", "segment_id").agg(F.min("t").alias("start"), first)
    segments = segments.select("trip_id", "segment_id", F.lead("first_ok").over(order).alias("after"))
    runs = df.where("run is not null").groupBy("trip_id", "segment_id", "block", "run").agg(
        F.bool_or("edge").alias("edge"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min("row_in_segment").alias("start_row"), F.max("row_in_segment").alias("end_row"),
        F.count("*").alias("samples"), F.max_by("next", "row_in_segment").alias("next"),
        *[F.min_by(F.when(valid_in(df, s), F.col(s)), "row_in_segment").alias(f"{n}_start") for s, n in (("coolant_temp", "ect"), ("ambient_temp", "aat"), ("intake_temp", "iat"))],
    ).where("edge")
    runs = runs.join(segments, ["trip_id", "segment_id"])
    reason = (
        F.when(F.col("next").isNotNull() & ~F.col("next.ok"), "rpm_invalid").when(F.col("next").isNotNull() & (F.col("next.block") != F.col("block")), "continuity_break")
        .when(F.col("next").isNotNull(), "rpm_below_50").when(F.col("after").isNull(), "end_of_data").when(~F.col("after"), "rpm_invalid").otherwise("continuity_break")
    )
    number = F.row_number().over(Window.partitionBy("trip_id").orderBy("start_t", "segment_id"))
    return runs.select(
        "trip_id", F.format_string("%s_start_%03d", F.col("trip_id"), number).alias("episode_id"), "segment_id", "start_t", "end_t", "start_row", "end_row", "samples", reason.alias("termination_reason"), "ect_start", "aat_start", "iat_start"
    )


def with_start_context(df: DataFrame, episodes: DataFrame) -> DataFrame:
    """Keys with the episode a sample lies in, the seconds since its start and the temperatures at it.

    A range join that meets at most one episode: samples look it up by segment and the last start before.
    """
    u = df.select(*KEYS, "t", F.lit(None).cast("struct<episode_id:string,start_row:int,end_row:int,start_t:bigint,ect_start:double,aat_start:double,iat_start:double>").alias("e"))
    marks = episodes.select("trip_id", "segment_id", F.col("start_row").alias("row_in_segment"), F.lit(None).cast("long").alias("t"), F.struct("episode_id", "start_row", "end_row", "start_t", "ect_start", "aat_start", "iat_start").alias("e"))
    w = Window.partitionBy("trip_id", "segment_id").orderBy("row_in_segment").rangeBetween(Window.unboundedPreceding, 0)
    j = u.unionByName(marks).withColumn("e", F.last("e", True).over(w)).where("t is not null")
    inside = F.col("row_in_segment") <= F.col("e.end_row")
    pick = lambda c: F.when(inside, F.col(f"e.{c}")).alias(c)
    return j.select(*KEYS, pick("episode_id"), F.when(inside, (F.col("t") - F.col("e.start_t")).cast("double")).alias("elapsed_since_start"), pick("ect_start"), pick("aat_start"), pick("iat_start"))


def cold_start(df: DataFrame, gap_s: float = 21_600.0, *, iat_witness: float = 7.0, ect_limit: float = 15.0, ect_witness: float = 15.0, iat_limit: float = 7.0) -> DataFrame:
    """1-S4 and 4-S2 by the first row of each segment, with the interval in which a warm intake lowers the confidence of other checks.

    Reasons are tried in order: no long enough gap, engine not off at the first row, no later start in the
    first row's block of valid engine speed, a reading that is not quality valid, an intake witness that
    fails. The other witness, the coolant, leaves the reason null. The interval runs from the qualifying
    start to the end of its block.
    """
    rpm_ok = valid_in(df, "rpm")
    df = local_blocks(df, rpm_ok, "block")
    here = F.col("block") == 1
    start = (F.col("rpm") >= k.ENGINE_ON_RPM) & (back("rpm") < k.ENGINE_ON_RPM) & here
    df = df.withColumns({"start": F.coalesce(start, F.lit(False)), "rpm_ok_": rpm_ok, "sound": valid_in(df, "coolant_temp", "ambient_temp", "intake_temp")})
    first = F.min_by(F.struct("row_in_segment", "t", "rpm", "rpm_ok_", "sound", "coolant_temp", "ambient_temp", "intake_temp", "block"), "row_in_segment")
    at = lambda when: F.struct("row_in_segment", "t") if when is None else F.when(when, F.struct("row_in_segment", "t"))
    a = df.groupBy("trip_id", "segment_id").agg(first.alias("f"), F.min(at(F.col("start"))).alias("q"), F.max(at(here)).alias("z")).where("f.row_in_segment = 1")
    a = a.join(segment_gaps(df), ["trip_id", "segment_id"])
    f = lambda x: F.col(f"f.{x}")
    a = a.withColumn("q", F.when((f("block") == 1) & (F.col("q.row_in_segment") > f("row_in_segment")), F.col("q")))
    iat, ect = F.abs(f("intake_temp") - f("ambient_temp")), F.abs(f("coolant_temp") - f("ambient_temp"))
    soaked, off = F.coalesce(F.col("gap_seconds") >= gap_s, F.lit(False)), F.coalesce(f("rpm_ok_") & (f("rpm") < k.ENGINE_ON_RPM), F.lit(False))
    later, sound = F.col("q").isNotNull(), f("sound")
    base, iat_ok, ect_ok = soaked & off & later & sound, F.coalesce(iat <= iat_witness, F.lit(False)), F.coalesce(ect <= ect_witness, F.lit(False))
    reason = (
        F.when(~soaked, "cold_soak_gap_unavailable").when(~off, "first_row_engine_on").when(~later, "no_observed_start_in_block").when(~sound, "signal_quality").when(~iat_ok, "iat_witness_failed")
    )
    warm = F.coalesce(base & ect_ok & (iat > iat_limit), F.lit(False))
    return a.select(
        "trip_id", "segment_id", f("t").alias("first_t"), "gap_seconds", F.col("q.row_in_segment").alias("qualifying_start"), ect.alias("ect_delta"), iat.alias("iat_delta"), reason.alias("reason"),
        (base & iat_ok).alias("s1s4_eligible"), F.when(base & iat_ok, ect > ect_limit).alias("s1s4_exceed"), (base & ect_ok).alias("s4s2_eligible"), F.when(base & ect_ok, iat > iat_limit).alias("s4s2_exceed"),
        *[F.when(warm, F.col(f"{x}.{y}")).alias(f"cap_{n}_{z}") for x, n in (("q", "start"), ("z", "end")) for y, z in (("row_in_segment", "row"), ("t", "t"))],
    )


def cold_decisions(cold: DataFrame, ect_limit: float = 15.0, iat_limit: float = 7.0) -> DataFrame:
    """Two support decisions, 1-S4 and 4-S2, per segment's first row."""
    one = lambda sub, rule, delta, limit, code: F.struct(F.lit(sub).alias("sub"), F.col(f"{rule}_eligible").alias("ok"), F.col(f"{rule}_exceed").alias("over"), (F.col(delta) - limit).alias("margin"), F.lit(code).alias("code"))
    both = cold.select("trip_id", "segment_id", "first_t", "reason", F.explode(F.array(one("1-S4", "s1s4", "ect_delta", ect_limit, "P0116"), one("4-S2", "s4s2", "iat_delta", iat_limit, "P0111"))).alias("d"))
    told, over = F.col("d.ok"), F.coalesce("d.over", F.lit(False))
    pick = lambda trig, ok, none: F.when(~told, none).when(over, trig).otherwise(ok)
    return both.select(
        "trip_id", F.col("d.sub").alias("sub_check_id"), "segment_id", F.col("first_t").alias("start_t"), F.col("first_t").alias("end_t"), F.lit(None).cast("string").alias("direction"), F.lit("support").alias("decision_role"),
        pick(F.lit("triggered"), F.lit("pass"), F.lit("not_evaluable")).alias("result_state"),
        pick(F.lit("cold_start_delta_exceeded"), F.lit("cold_start_delta_within_bound"), F.coalesce("reason", F.lit("witness_or_quality_failed"))).alias("decision_reason"), F.when(told, F.col("d.margin")).alias("decision_margin"),
        F.col("d.code").alias("dtc_candidate"), F.lit(1).cast("long").alias("evidence_count"), told.alias("opportunity_present"),
    )


def warmup_budget(ect: Column, rates: tuple[float, ...], target: float = 79.0, edges: tuple[float, ...] = (30.0, 50.0, 65.0, 79.0), safety: float = 1.3) -> Column:
    """Seconds allowed from ``ect`` to ``target``: each band's part over its rate in degrees a minute, with a margin; rates are job parameters."""
    total, low = F.lit(0.0), -273.0
    for edge, rate in zip(edges, rates):
        total = total + F.greatest(F.lit(0.0), F.lit(min(edge, target)) - F.greatest(ect, F.lit(low))) / rate * 60
        low = edge
    return total * safety


#: Degrees a minute in each band of the coolant, by ambient bin; job parameters, not published.
RATES = {"low": (9.0, 7.0, 5.0, 4.0), "high": (10.0, 8.0, 6.0, 5.0)}


def warmup_evidence(
    samples: DataFrame, context: DataFrame, episodes: DataFrame, cold: DataFrame, rates: dict = RATES, *, target: float = 79.0, start_max: float = 50.0, frost: float = -7.0, split: float = 10.0, most_s: float = 1800.0, heat: float = 1500.0
) -> DataFrame:
    """1-S1: per episode its guards, budget and ambient bin, the time to ``target``, whether observation ended first, the heat put in when the budget ran out, and what 1-S4 says of it.

    ``samples`` hold the coolant with its flags and ``maf_integral``. Support comes from the first row of a
    segment, for the episode that the cold start waited for; for all others it is unavailable.
    """
    valid = valid_in(samples, "coolant_temp")
    j = context.where("episode_id is not null").select(*KEYS, "episode_id", "elapsed_since_start").join(samples.select(*KEYS, "coolant_temp", "maf_integral", F.coalesce(valid, F.lit(False)).alias("ok")), list(KEYS))
    e = episodes.select("trip_id", "episode_id", "segment_id", "start_t", "end_t", "start_row", "ect_start", "aat_start", (F.col("end_t") - F.col("start_t")).cast("double").alias("observed_s"))
    guards = F.coalesce((F.col("ect_start") <= start_max) & (F.col("ect_start") < target) & (F.col("aat_start") >= frost), F.lit(False))
    bin_ = F.when(F.col("aat_start") <= split, "low").otherwise("high")
    budget = F.round(F.when(bin_ == "low", warmup_budget(F.col("ect_start"), rates["low"], target)).otherwise(warmup_budget(F.col("ect_start"), rates["high"], target)), 6)
    e = e.withColumns({"guards": guards, "ambient_bin": F.when(guards, bin_), "budget_s": F.when(guards, budget)}).withColumn("in_domain", F.col("budget_s") <= most_s)
    a = j.join(e.select("trip_id", "episode_id", "budget_s"), ["trip_id", "episode_id"]).groupBy("trip_id", "episode_id").agg(
        F.min(F.when(F.col("ok") & (F.col("coolant_temp") >= target), F.col("elapsed_since_start"))).alias("reached_s"),
        F.min_by("maf_integral", F.when(F.col("elapsed_since_start") >= F.col("budget_s"), F.col("elapsed_since_start"))).alias("heat_at_expiry"),
    )
    told = cold.select("trip_id", "segment_id", F.col("qualifying_start").alias("start_row"), F.lit(True).alias("soak"), "s1s4_eligible", "s1s4_exceed", F.col("reason").alias("cold_reason"))
    e = e.join(a, ["trip_id", "episode_id"], "left").join(told, ["trip_id", "segment_id", "start_row"], "left")
    live = F.col("guards") & F.coalesce("in_domain", F.lit(False))
    support = F.coalesce(F.col("soak") & F.col("s1s4_eligible"), F.lit(False))
    return e.withColumns(
        {
            "censored": F.when(live, F.col("reached_s").isNull() & (F.col("observed_s") < F.col("budget_s"))), "heat_at_expiry": F.when(live, F.col("heat_at_expiry")), "support_evaluable": support,
            "support_exceed": F.when(support, F.col("s1s4_exceed")), "support_reason": F.when(~support, F.coalesce("cold_reason", F.lit("cold_soak_unavailable"))),
        }
    ).withColumn("heat_passed", F.col("heat_at_expiry") > heat).drop("soak", "s1s4_eligible", "s1s4_exceed", "cold_reason")


COLD_SOAK_ONLY = ("cold_soak_gap_unavailable", "first_row_engine_on", "no_observed_start_in_block")


def start_decisions(evidence: DataFrame) -> DataFrame:
    """1-S1 per episode: an ordered tree of reasons. A failed support check says that the sensor is not to be trusted; a pass asks for one that passes."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    in_time, over = yes(c("reached_s") <= c("budget_s")), yes(c("support_evaluable") & c("support_exceed"))
    passes, soak_only = c("support_evaluable") & ~over, yes(~c("support_evaluable") & c("support_reason").isin(*COLD_SOAK_ONLY))
    why = (
        F.when(~c("guards"), "start_guards_failed").when(~yes(c("in_domain")), "budget_out_of_domain").when(over, "support_triggered_sensor_untrusted")
        .when(in_time & passes, "target_reached_within_budget").when(in_time & soak_only, "support_cold_soak_unavailable_pass_forbidden").when(in_time, "support_not_evaluable")
        .when(yes(c("censored")), "right_censored").when(~yes(c("heat_passed")), "insufficient_heat_input").when(passes | soak_only, "budget_expired_below_target").otherwise("support_not_evaluable")
    )
    state = F.when(why == "target_reached_within_budget", "pass").when(why == "budget_expired_below_target", "triggered").otherwise("not_evaluable")
    margin = F.when(state == "pass", c("budget_s") - c("reached_s")).when(state == "triggered", c("reached_s") - c("budget_s"))
    return evidence.select(
        "trip_id", "episode_id", F.lit("1-S1").alias("sub_check_id"), "segment_id", "start_t", "end_t", F.lit("low").alias("direction"), F.lit("verdict").alias("decision_role"), state.alias("result_state"), why.alias("decision_reason"),
        F.round(margin, 6).alias("decision_margin"), F.lit("P0128").alias("dtc_candidate"), F.lit(1).cast("long").alias("evidence_count"), (state != "not_evaluable").alias("opportunity_present"),
    )
