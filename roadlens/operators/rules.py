"""Rule state of samples, duration episodes and the decisions of a trip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.operators.continuity import KEYS, ahead, back, bit, bits, depth, ok, runs_of, segment_window, whole_blocks, without


def cond_where(eligible: Column, condition: Column) -> Column:
    """Null outside ``eligible``; inside, a condition on a missing value is false."""
    return F.when(F.coalesce(eligible, F.lit(False)), F.coalesce(condition, F.lit(False)))


def rule_state(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Keys, ``t``, ``block`` with its start, ``intake_temp`` and, for each rule, eligibility and conditions as nullable booleans; ``df`` has all features and states.

    Rule 1-S2 asks for the ambient limit on every sample, as it is computed, not only where a window starts.
    """
    m, c, q = k.LIMITS | (limits or {}), F.col, ok
    df = whole_blocks(df)
    engine_on = F.coalesce(c("engine_on_flag"), F.lit(False))
    post, high = c("thermal_state") == "post_warmup", c("condition_confidence") == "high"
    pedal = q(["accel_pedal_d", "accel_pedal_e"])
    lasting = {"3-S1a": m["s3s1a_mask"], "5-S2": m["s5s2_mask"]}  # rules that ask for a state that has held for so many samples of the block
    asked = {
        "3-S1a": engine_on & pedal & (F.abs(c("pedal_slope")) <= m["s3s1a_slope"]),
        "5-S2": pedal & q(["rpm"]) & (c("pedal_slope") == 0) & (F.abs(c("rpm_slope")) <= m["s5s2_rpm_slope"]),
    }
    yes = lambda x: F.coalesce(x, F.lit(False))
    material_iat = yes(c("speed_std") >= m["speed_std"]) | yes(c("maf_std") >= m["maf_std"])
    material_map = yes(c("rpm_std") >= m["rpm_std"]) | yes(c("speed_std") >= m["speed_std"]) | yes(c("accel_pedal_mean_std") >= m["pedal_std"])
    e = {
        "1-S2": engine_on & post & q(["coolant_temp", "ambient_temp"]) & yes(c("ambient_temp") <= m["s1s2_ambient"]),
        "1-S3": post & q(["coolant_temp"]) & c("ect_rate").isNotNull(),
        "2-S2": (c("operating_state") == "post_warmup__high_load") & high & c("speed_density_maf_residual").isNotNull(),
        "2-S3b": q(["maf", "rpm"]),
        "3-S1a": c("pedal_mapping_residual").isNotNull(),
        "3-S1b": c("accel_pedal_channel_delta").isNotNull(),
        "4-S1": engine_on & q(["intake_temp", "speed", "maf"]),
        "5-S2": (c("operating_state") == "post_warmup__steady_driving") & c("speed_density_maf_residual").isNotNull(),
        "5-S3": engine_on & q(["map", "rpm", "speed"]),
    }
    conditions = {
        ("1-S2", "high"): c("coolant_temp") >= m["s1s2_high"],
        ("1-S2", "critical"): c("coolant_temp") >= m["s1s2_critical"],
        ("1-S3", "precursor"): (c("ect_rate") >= m["s1s3_rate"]) & (c("coolant_temp") >= m["s1s3_level"]),
        ("2-S2", "low"): c("speed_density_maf_residual") < m["s2s2_residual"],
        ("2-S3b", "zero_maf"): (c("maf") == 0) & (c("rpm") >= m["s2s3b_rpm"]),
        ("3-S1a", "low"): c("pedal_mapping_residual") < m["s3s1a_low"],
        ("3-S1a", "high"): c("pedal_mapping_residual") > m["s3s1a_high"],
        ("3-S1b", "extreme"): c("accel_pedal_channel_delta") >= m["s3s1b_delta"],
        ("5-S2", "low"): c("speed_density_maf_residual") < m["s5s2_low"],
        ("5-S2", "high"): c("speed_density_maf_residual") > m["s5s2_high"],
    }
    out = [F.coalesce(v, F.lit(False)).alias(f"{column(r, 'eligible')}") for r, v in e.items()]
    out += [cond_where(e[r], v).alias(column(r, kind)) for (r, kind), v in conditions.items()]
    out += [
        (yes(e["4-S1"]) & material_iat).alias(column("4-S1", "context")),
        cond_where(e["4-S1"] & c("intake_temp_stability").isNotNull(), c("intake_temp_stability") <= m["s4s1_stability"]).alias(column("4-S1", "flat")),
        (yes(e["5-S3"]) & material_map).alias(column("5-S3", "context")),
        cond_where(e["5-S3"] & c("map_range").isNotNull(), c("map_range") == m["s5s3_flat"]).alias(column("5-S3", "flat")),
        cond_where(q(["intake_temp"]), c("intake_temp") < m["s4s3_low"]).alias("s4s3_below"),
        cond_where(q(["intake_temp"]), c("intake_temp") > m["s4s3_high"]).alias("s4s3_above"),
        yes(post & high & q(["map", "accel_pedal_d", "accel_pedal_e"])).alias("s5s1_domain"),
    ]
    df = df.select(*KEYS, "t", "block", "block_start", "intake_temp", *out, *[v.alias(f"_{r}") for r, v in asked.items()])
    told = df.columns[: -len(asked)]
    df = runs_of(df, {f"_{r}": c(f"_{r}") for r in asked})
    held = {r: yes(c("row_in_segment") - c(f"_{r}_start") >= n - 1) for r, n in lasting.items()}
    own = {column(r, "eligible"): held[r] & c(column(r, "eligible")) for r in asked} | {column(r, kind): F.when(held[r], c(column(r, kind))) for r, kind in conditions if r in asked}
    return df.select(*[own[x].alias(x) if x in own else x for x in told])


def column(rule: str, kind: str) -> str:
    return f"s{rule.replace('-', '').lower()}_{kind}"


def episodes(state: DataFrame, rules: dict | None = None) -> DataFrame:
    """Runs of each rule's eligible, context and condition columns, by (rule_id, kind), a row each.

    Duration is the number of samples, the elapsed span one less. A run never leaves its block. Each
    sample knows where its runs began, and the last sample of a run gives the row: no cell is dealt out
    or sorted again. Windows carry one bit a column.
    """
    rules = rules or k.DURATION_RULES
    held, kinds_of = {}, {}
    for rule, (kinds, opportunity, *_ ) in rules.items():
        specs = [("eligible", None), *(((kind, seconds)) for kind, _, seconds in kinds)] + ([("context", None)] if opportunity.endswith("context") else [])
        for kind, seconds in specs:
            name, flag = f"_e{len(held)}", F.coalesce(F.col(column(rule, kind)), F.lit(False))
            held[name] = flag if kind in ("eligible", "context") else flag & F.coalesce(F.col(column(rule, "eligible")), F.lit(False))
            kinds_of[name] = (rule, kind, seconds)
    w, row, none = segment_window(), F.col("row_in_segment"), F.lit(0).cast("long")
    df = state.select(*KEYS, "t", "block", "block_start", F.when(F.col("block").isNotNull(), bits(held.values())).otherwise(none).alias("_held"))
    df = df.withColumns({"_before": F.lag("_held").over(w), "_after": F.lead("_held").over(w), "_next": F.lead("block_start").over(w)})
    same = F.col("_next") == F.col("block_start")
    df = df.withColumns({"_begins": without("_held", F.when(depth() >= 1, F.col("_before"))), "_ends": without("_held", F.when(same, F.col("_after")))})
    df = df.select(*KEYS, "t", "block", "_ends", *[F.max(F.when(bit("_begins", i), row)).over(w).alias(f"{n}_start") for i, n in enumerate(held)]).where(F.col("_ends") != 0)
    cells = []
    for i, (n, (rule, kind, seconds)) in enumerate(kinds_of.items()):
        start = F.col(f"{n}_start")
        cells.append(F.when(bit("_ends", i), F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("kind"), F.lit(seconds).cast("double").alias("required_s"), (F.col("t") - (row - start)).alias("start_t"), start.alias("start_row"))))
    out = df.select("trip_id", "segment_id", "block", F.col("t").alias("end_t"), row.alias("end_row"), F.explode(F.array(*cells)).alias("s")).where("s is not null")
    samples = F.col("end_row") - F.col("s.start_row") + 1
    n = samples.cast("double")
    return out.select(
        "trip_id", "segment_id", "block", "s.rule_id", "s.kind", "s.required_s", "s.start_t", "end_t", "s.start_row", "end_row", samples.cast("long").alias("samples"),
        n.alias("duration_s"), (n - 1).alias("span_s"), (n >= F.col("s.required_s")).alias("meets"), (n - F.col("s.required_s")).alias("margin_s"),
    )


def duration_decisions(eps: DataFrame, trips: DataFrame, rules: dict | None = None) -> DataFrame:
    """One row a trip and rule. ``trips``: (trip_id, start_t, end_t); every trip gets a row of each rule.

    The first kind in the rule's order that persists gives direction, margin and span; it triggers even
    without an opportunity. A pass reports the best margin over kinds. One grouped aggregate of episodes.
    """
    rules = rules or k.DURATION_RULES
    kind, meets = F.col("kind"), F.coalesce(F.col("meets"), F.lit(False))
    one = lambda when, value: F.when(when, value)
    aggs = [
        F.max(one(kind == "eligible", F.col("duration_s"))).alias("longest"),
        F.sum(one(kind == "eligible", F.col("duration_s"))).alias("total"),
        F.count(one(kind == "context", F.lit(1))).alias("contexts"),
        F.min(one(kind == "eligible", F.col("start_t"))).alias("e_start"),
        F.max(one(kind == "eligible", F.col("end_t"))).alias("e_end"),
        F.min(one(kind == "eligible", F.col("segment_id"))).alias("e_seg"),
        F.max(one(kind == "eligible", F.col("segment_id"))).alias("e_seg2"),
        F.count(one(~kind.isin("eligible", "context"), F.lit(1))).alias("evidence_count"),
    ]
    names = sorted({n for kinds, *_ in rules.values() for n, *_ in kinds})
    for n in names:
        own = kind == n
        aggs += [
            F.max(one(own, F.col("margin_s"))).alias(f"{n}_margin"),
            F.max(one(own & meets, F.col("margin_s"))).alias(f"{n}_met"),
            F.min(one(own & meets, F.col("start_t"))).alias(f"{n}_start"),
            F.max(one(own & meets, F.col("end_t"))).alias(f"{n}_end"),
            F.min(one(own & meets, F.col("segment_id"))).alias(f"{n}_seg"),
            F.max(one(own & meets, F.col("segment_id"))).alias(f"{n}_seg2"),
        ]
    found = eps.groupBy("trip_id", "rule_id").agg(*aggs)
    grid = trips.select("trip_id", "start_t", "end_t", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule_id"))
    df = grid.join(found, ["trip_id", "rule_id"], "left")
    chosen = []
    for rule, (kinds, opportunity, seconds, role, code) in rules.items():
        met = [F.when(F.col(f"{n}_met").isNotNull(), F.struct(F.lit(d).cast("string").alias("direction"), F.col(f"{n}_met").alias("margin"), F.col(f"{n}_start").alias("s"), F.col(f"{n}_end").alias("e"), F.when(F.col(f"{n}_seg") == F.col(f"{n}_seg2"), F.col(f"{n}_seg")).alias("seg"))) for n, d, _ in kinds]
        best, direction = F.lit(None).cast("double"), F.lit(None).cast("string")
        for n, d, _ in kinds:
            better = F.col(f"{n}_margin").isNotNull() & (best.isNull() | (F.col(f"{n}_margin") > best))
            best, direction = F.when(better, F.col(f"{n}_margin")).otherwise(best), F.when(better, F.lit(d).cast("string")).otherwise(direction)
        chance = (F.col("total") if opportunity == "total_eligible" else F.col("longest")) >= seconds
        if opportunity.endswith("context"):
            chance = chance & (F.col("contexts") > 0)
        chosen.append(
            F.when(
                F.col("rule_id") == rule,
                F.struct(
                    F.coalesce(*met).alias("met"), best.alias("best"), direction.alias("direction"), F.coalesce(chance, F.lit(False)).alias("opportunity"),
                    F.lit(role).alias("role"), F.lit(code).cast("string").alias("code"),
                ),
            )
        )
    df = df.withColumn("d", F.coalesce(*chosen))
    met, chance = F.col("d.met"), F.col("d.opportunity")
    e_seg = F.when(F.col("e_seg") == F.col("e_seg2"), F.col("e_seg"))
    active = F.when(F.col("d.role") == "pending_precursor", "pending").otherwise("triggered")
    pick = lambda trig, none, ok: F.when(met.isNotNull(), trig).when(~chance, none).otherwise(ok)
    reasons = F.create_map(*[F.lit(x) for r in rules for x in (r, k.NO_OPPORTUNITY.get(r, "no_qualifying_opportunity"))])
    return df.select(
        "trip_id",
        F.col("rule_id").alias("sub_check_id"),
        pick(met["seg"], e_seg, e_seg).alias("segment_id"),
        pick(met["s"], F.coalesce("e_start", "start_t"), F.col("e_start")).alias("start_t"),
        pick(met["e"], F.coalesce("e_end", "end_t"), F.col("e_end")).alias("end_t"),
        pick(met["direction"], F.lit(None), F.col("d.direction")).alias("direction"),
        F.col("d.role").alias("decision_role"),
        pick(active, F.lit("not_evaluable"), F.lit("pass")).alias("result_state"),
        pick(F.lit("condition_persistence_met"), F.element_at(reasons, F.col("rule_id")), F.lit("no_trigger_with_opportunity")).alias("decision_reason"),
        pick(met["margin"], F.lit(None), F.col("d.best")).alias("decision_margin"),
        F.col("d.code").alias("dtc_candidate"),
        F.coalesce("evidence_count", F.lit(0)).cast("long").alias("evidence_count"),
        chance.alias("opportunity_present"),
    )


def range_decisions(state: DataFrame, limits: dict | None = None) -> DataFrame:
    """4-S3: one row a trip; below the range goes before above; the margin is the worst excess, and evidence the violations, or else the samples that could be told."""
    m = k.LIMITS | (limits or {})
    low, high = F.coalesce("s4s3_below", F.lit(False)), F.coalesce("s4s3_above", F.lit(False))
    told, hit = F.col("s4s3_below").isNotNull(), low | high
    ends = lambda when, n: [F.min(F.when(when, F.col("t"))).alias(f"{n}_start"), F.max(F.when(when, F.col("t"))).alias(f"{n}_end"), F.min(F.when(when, F.col("segment_id"))).alias(f"{n}_seg"), F.max(F.when(when, F.col("segment_id"))).alias(f"{n}_seg2"), F.count(F.when(when, 1)).alias(f"{n}_n")]
    a = state.groupBy("trip_id").agg(
        F.max(F.when(low, m["s4s3_low"] - F.col("intake_temp"))).alias("low"), F.max(F.when(high, F.col("intake_temp") - m["s4s3_high"])).alias("high"),
        *ends(F.lit(True), "trip"), *ends(told, "told"), *ends(hit, "hit"),
    )
    fired, known = F.col("hit_n") > 0, F.col("told_n") > 0
    pick = lambda x: F.when(fired, F.col(f"hit_{x}")).when(known, F.col(f"told_{x}")).otherwise(F.col(f"trip_{x}"))
    direction = F.when(F.col("low").isNotNull(), "low").when(F.col("high").isNotNull(), "high")
    return a.select(
        "trip_id", F.lit("4-S3").alias("sub_check_id"), F.when(known & (pick("seg") == pick("seg2")), pick("seg")).alias("segment_id"), pick("start").alias("start_t"), pick("end").alias("end_t"), direction.alias("direction"),
        F.lit("verdict").alias("decision_role"), F.when(fired, "triggered").when(known, "pass").otherwise("not_evaluable").alias("result_state"),
        F.when(fired, "range_violation").when(known, "no_trigger_with_opportunity").otherwise("signal_unavailable").alias("decision_reason"), F.coalesce("low", "high").alias("decision_margin"),
        F.when(direction == "low", "P0112").when(direction == "high", "P0113").alias("dtc_candidate"), F.when(fired, F.col("hit_n")).otherwise(F.col("told_n")).alias("evidence_count"), known.alias("opportunity_present"),
    )


def pedal_events(df: DataFrame, steps: dict | None = None, no_response: dict | None = None, split: dict | None = None) -> DataFrame:
    """5-S1: a row per sample of the domain whose pedal slope reaches its state's step upwards; consecutive ones are events of their own.

    The domain is warmed up, confident, and quality valid in pressure and both pedals. A window is complete
    if the block holds the row before and two after, all of them quality valid; an event is evaluable if
    its state and magnitude have a limit besides. Less response than the limit is none. Of a trip's last
    four complete events three without a response trigger; those that have no limit take a slot. States are
    operating states, keyed here by what follows the thermal one; a state without a magnitude split falls into ``lo``.
    """
    steps, no_response, split = steps or k.PEDAL_STEPS, no_response or k.NO_RESPONSE, split or {}
    c = F.col
    known = {f"post_warmup__{s}": v for s, v in steps.items()}
    look = lambda d: F.element_at(F.create_map(*[x for s in known for x in (F.lit(s), F.lit(d.get(s.removeprefix("post_warmup__"))).cast("double"))]), c("operating_state"))
    df = whole_blocks(df)
    sound = F.coalesce(ok(["map", "accel_pedal_d", "accel_pedal_e"]), F.lit(False))
    df = df.withColumn("sound", sound)
    base = back("map")
    response = F.greatest(*[F.abs((c("map") if o == 0 else ahead("map", o)) - base) for o in range(3)])
    inside = F.coalesce(depth() >= 1, F.lit(False)) & ahead("t", 2).isNotNull()
    around = F.coalesce(back("sound") & ahead("sound", 1) & ahead("sound", 2), F.lit(False))
    df = df.withColumns({"inside": inside, "around": around, "base": base, "response": response, "step": look(steps), "split": look(split)})
    domain = (c("thermal_state") == "post_warmup") & (c("condition_confidence") == "high") & c("sound")
    df = df.where(domain & (c("pedal_slope") >= c("step")))
    big = F.coalesce(c("pedal_slope") >= c("split"), F.lit(False))
    limit = F.when(big, look({s: b for s, (_, b) in no_response.items()})).otherwise(look({s: a for s, (a, _) in no_response.items()}))
    df = df.withColumns({"complete": c("inside") & c("around"), "limit": limit})
    told = c("complete") & c("limit").isNotNull()
    result = F.when(c("complete") & ~told, "not_evaluable").when(told & (c("response") < c("limit")), "no_response").when(told, "response")
    df = df.withColumn("result", result)
    trip = Window.partitionBy("trip_id").orderBy("t", "segment_id", "row_in_segment")
    done = Window.partitionBy("trip_id", "complete").orderBy("t", "segment_id", "row_in_segment")
    last = done.rowsBetween(-3, 0)
    whole = lambda x: F.when(c("complete"), x)
    missed = whole(F.sum(F.coalesce((c("result") == "no_response").cast("int"), F.lit(0))).over(last))
    return df.select(
        *KEYS, "t", c("block").alias("continuity_block_id"), "operating_state", "pedal_slope", c("step").alias("pedal_step_threshold"), F.when(big, "hi").otherwise("lo").alias("magnitude_bin"), c("split").alias("magnitude_split_threshold"),
        c("complete").alias("window_complete"), F.when(~c("inside"), "neighborhood_outside_block").when(~c("around"), "neighborhood_quality").alias("window_incomplete_reason"), whole(c("base")).alias("baseline_map"),
        whole(c("response")).alias("response_kpa"), c("limit").alias("no_response_threshold_kpa"), told.alias("evaluable"), c("result").alias("event_result"), F.row_number().over(trip).alias("event_index_in_trip"),
        whole(F.row_number().over(done)).alias("complete_event_ordinal"), whole(F.count(F.lit(1)).over(last)).cast("int").alias("recent_window_size"), missed.cast("int").alias("no_response_count_recent_n"),
        (missed >= 3).alias("m_of_n_triggered"), (missed - 3).cast("int").alias("decision_margin"),
    )


def step_decisions(events: DataFrame, trips: DataFrame) -> DataFrame:
    """5-S1: one row for each of ``trips`` (trip_id, start_t, end_t). One evaluable event is an opportunity; without one the trip is not evaluable."""
    told = F.col("evaluable")
    a = events.groupBy("trip_id").agg(
        F.count_if(told).alias("n"), F.bool_or("m_of_n_triggered").alias("fired"), F.max("no_response_count_recent_n").alias("most"), F.min(F.when(told, F.col("t"))).alias("s"), F.max(F.when(told, F.col("t"))).alias("e"),
        F.min(F.when(told, F.col("segment_id"))).alias("seg"), F.max(F.when(told, F.col("segment_id"))).alias("seg2"),
    )
    j = trips.select("trip_id", "start_t", "end_t").join(a, "trip_id", "left")
    chance, fired = F.coalesce(F.col("n") > 0, F.lit(False)), F.coalesce("fired", F.lit(False))
    pick = lambda trig, ok_, none: F.when(~chance, none).when(fired, trig).otherwise(ok_)
    return j.select(
        "trip_id", F.lit("5-S1").alias("sub_check_id"), F.when(chance & (F.col("seg") == F.col("seg2")), F.col("seg")).alias("segment_id"), F.when(chance, F.col("s")).otherwise(F.col("start_t")).alias("start_t"),
        F.when(chance, F.col("e")).otherwise(F.col("end_t")).alias("end_t"), F.lit(None).cast("string").alias("direction"), F.lit("verdict").alias("decision_role"), pick(F.lit("triggered"), F.lit("pass"), F.lit("not_evaluable")).alias("result_state"),
        pick(F.lit("m_of_n_met"), F.lit("no_trigger_with_opportunity"), F.lit("no_valid_events")).alias("decision_reason"), F.when(chance, F.coalesce("most", F.lit(0)) - 3).cast("double").alias("decision_margin"),
        F.lit("P0106").alias("dtc_candidate"), F.coalesce("n", F.lit(0)).cast("long").alias("evidence_count"), chance.alias("opportunity_present"),
    )


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
