"""Re-fitting of frozen models, re-derivation of frozen thresholds, and how far each depends on a single trip."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.functions.physics import clip
from roadlens.operators.ranks import exact_quantiles, numbered, running_totals
from roadlens.sources.scratch import written

AUDIT = "sub_check string, param string, frozen double, rederived double, tolerance double, unit string, status string, n long"


# -- least squares ------------------------------------------------------------------------------------------------


def least_squares(df: DataFrame, inputs: dict[str, Column], target: Column, about: dict[str, float] | None = None) -> tuple[int, dict[str, float], float]:
    """(rows, coefficients, intercept) of the linear model of ``target``; rows with a null are left out.

    One aggregate gives all sums and cross products, of values less ``about`` so that little cancels; the driver solves a system as large as the model.
    Inputs that tell nothing new share their coefficient as the least-norm solution does. Without rows: not a number.
    """
    about = {n: 0.0 for n in inputs} | (about or {})
    cells = {n: (c - F.lit(about[n])).alias(n) for n, c in inputs.items()} | {"_y": target.alias("_y")}
    x, names = df.select(*cells.values()).dropna(), [*inputs, "_y"]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{i}:{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = x.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names], *products).first()
    n = row["n"]
    if not n:
        return 0, dict.fromkeys(inputs, float("nan")), float("nan")
    mean = np.array([row[c] / n for c in names])
    both = np.array([[row[f"{min(i, j)}:{max(i, j)}"] / n for j in range(len(names))] for i in range(len(names))]) - np.outer(mean, mean)
    spread = np.diag(both)[:-1]
    moves = np.flatnonzero(spread > 1e-13 * np.square(mean[:-1]))  # an input that stays the same has no coefficient
    size, found = np.sqrt(spread[moves]), np.zeros(len(inputs))
    found[moves] = np.linalg.lstsq(both[np.ix_(moves, moves)] / np.outer(size, size), both[moves, -1] / size, rcond=None)[0] / size
    return n, dict(zip(inputs, map(float, found))), float(mean[-1] - found @ (mean[:-1] + np.array([about[c] for c in inputs])))


def speed_density_inputs(p: dict = k.SPEED_DENSITY) -> dict[str, Column]:
    """The model's four inputs, each clipped to the range it was fitted on."""
    c = F.col
    load = c("map") * c("rpm") / (c("intake_temp") + 273.15)
    raw = {"air_load": load, "map": c("map"), "rpm": c("rpm"), "iat": c("intake_temp")}
    return {n: clip(x, *p[f"clip_{n}"]) for n, x in raw.items()}


def refit_speed_density(
    samples: DataFrame, winsor: tuple[float, float], frozen_rows: int, p: dict = k.SPEED_DENSITY, *, least: int = 1000, tolerance: float = 1e-3, row_tolerance: float = 100.0
) -> DataFrame:
    """Audit rows of the speed-density model, fitted anew on steady, confident samples with the engine on; the target is drawn to ``winsor``.

    Fewer than ``least`` samples give the row count only.
    """
    on = (F.col("child_state") == "steady_driving") & (F.col("condition_confidence") == "high") & (F.col("rpm") >= k.ENGINE_ON_RPM)
    middle = {n: sum(p[f"clip_{n}"]) / 2 for n in ("air_load", "map", "rpm", "iat")}
    n, found, intercept = least_squares(samples.where(on), speed_density_inputs(p), clip(F.col("maf"), *winsor), middle)
    rows = [] if n < least else [(f"coeff_{c}", p[c], v, tolerance, "relative") for c, v in found.items()] + [("intercept", p["intercept"], intercept, tolerance, "relative")]
    rows.append(("training_row_count", float(frozen_rows), float(n), row_tolerance, "rows"))
    far = lambda frozen, now, unit: abs(now - frozen) / (max(abs(frozen), 1e-12) if unit == "relative" else 1.0)
    made = [("speed_density", c, frozen, now, tol, unit, "PASS" if far(frozen, now, unit) <= tol else "FAIL", n) for c, frozen, now, tol, unit in rows]
    return samples.sparkSession.createDataFrame(made, AUDIT)


def refit_pedal_map(samples: DataFrame, p: dict = k.PEDAL_MAP, *, least: int = 1000) -> DataFrame:
    """Audit rows of the line of pedal channel E on D, over samples with a residual and the engine on; INCOMPLETE with fewer than ``least``."""
    e, d = F.col("accel_pedal_e"), F.col("accel_pedal_d")
    line = samples.where(F.col("pedal_mapping_residual").isNotNull() & (F.col("rpm") >= k.ENGINE_ON_RPM)).agg(F.regr_slope(e, d).alias("a"), F.regr_intercept(e, d).alias("b"), F.regr_count(e, d).alias("n"))
    rows = F.array(*[F.struct(F.lit(x).alias("param"), F.lit(p[name]).alias("frozen"), F.col(x).alias("now"), F.lit(tol).alias("tolerance"), F.lit(unit).alias("unit")) for x, name, tol, unit in (("a", "slope", 0.02, "dimensionless"), ("b", "intercept", 0.3, "percentage_point"))])
    r = line.select("n", F.explode(rows).alias("r"))
    enough = F.col("n") >= least
    status = F.when(~enough | F.col("r.now").isNull(), "INCOMPLETE").when(F.abs(F.col("r.now") - F.col("r.frozen")) <= F.col("r.tolerance"), "PASS").otherwise("FAIL")
    return r.select(F.lit("pedal_mapping").alias("sub_check"), "r.param", "r.frozen", F.when(enough, F.col("r.now")).alias("rederived"), "r.tolerance", "r.unit", status.alias("status"), "n")


# -- thresholds ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """A frozen value and how it is derived: a statistic of ``value`` over the samples of ``mask``.

    ``statistic``: ``min``, ``max``, ``q<share>`` (of all samples), ``trips<share>`` (each trip weighs the same), ``medians`` (median of the trips' medians)
    or ``above`` (the frozen value must lie above the maximum). Fewer than ``least`` samples leave the check INCOMPLETE.
    """

    sub_check: str
    param: str
    mask: Column
    value: Column
    statistic: str
    frozen: float
    tolerance: float
    unit: str
    least: int = 1


def published_checks(limits: dict | None = None, steps: dict | None = None, windows: dict[str, str] | None = None) -> list[Check]:
    """The data-derived checks of all rules; tolerances are fixed values. ``windows`` names the window features of the table."""
    m, steps, c = k.LIMITS | (limits or {}), steps or k.PEDAL_STEPS, F.col
    w = {x: x for x in ("speed_std", "maf_std", "rpm_std", "accel_pedal_mean_std")} | (windows or {})
    post, on = c("thermal_state") == "post_warmup", c("rpm") >= k.ENGINE_ON_RPM
    soaked = (c("row_in_segment") == 1) & (c("segment_gap_seconds") >= m.get("soak_gap_s", 21_600.0)) & (c("rpm") < k.ENGINE_ON_RPM)
    soaked = soaked & c("coolant_temp").isNotNull() & c("ambient_temp").isNotNull() & c("intake_temp").isNotNull()
    iat, ect = F.abs(c("intake_temp") - c("ambient_temp")), F.abs(c("coolant_temp") - c("ambient_temp"))
    witness, trigger = m.get("iat_witness", 7.0), m.get("ect_trigger", 15.0)
    still = on & (F.abs(c("pedal_slope")) <= m["s3s1a_slope"])
    always = F.lit(True)
    checks = [
        Check("shared", "engine_on_rpm_value", on, c("rpm"), "min", k.ENGINE_ON_RPM, 0.0, "rpm"),
        Check("1-S1", "thermostat_regulating_estimate_c", post, c("coolant_temp"), "medians", m.get("regulating", 90.0), 1.0, "degC"),
        Check("1-S2", "tier_high_temperature_c", post, c("coolant_temp"), "above", m["s1s2_high"], 0.01, "degC"),
        Check("1-S2", "tier_critical_temperature_c", post, c("coolant_temp"), "above", m["s1s2_critical"], 0.01, "degC"),
        Check("1-S4", "iat_witness_delta_c", soaked & (iat <= witness), iat, "max", witness, 2.0, "degC"),
        Check("1-S4", "ect_trigger_delta_c", soaked & (iat <= witness), ect, "max", trigger, 5.0, "degC"),
        Check("2-S2", "residual_threshold_g_per_s", (c("operating_state") == "post_warmup__high_load") & (c("condition_confidence") == "high"), c("speed_density_maf_residual"), "q0.005", m["s2s2_residual"], 2.0, "g/s"),
        Check("3-S1a", "residual_band_low", still, c("pedal_mapping_residual"), "q0.005", m["s3s1a_low"], 2.0, "pp", 1001),
        Check("3-S1a", "residual_band_high", still, c("pedal_mapping_residual"), "q0.995", m["s3s1a_high"], 2.0, "pp", 1001),
        Check("3-S1b", "channel_delta_pp", always, c("accel_pedal_channel_delta"), "above", m["s3s1b_delta"], 5.0, "pp"),
    ]
    checks += [Check("4-S1", f"context_{x}_120s", always, c(w[x]), "trips0.5", m[x], m[x] * 0.1, u) for x, u in (("speed_std", "km/h"), ("maf_std", "g/s"))]
    for state, step in steps.items():
        moving = (c("operating_state") == f"post_warmup__{state}") & (c("pedal_slope") > 0) & (c("condition_confidence") == "high")
        checks.append(Check("5-S1", f"post_warmup__{state}_pedal_step_P95", moving, c("pedal_slope"), "q0.95", step, step * 0.15, "pp/s", 101))
    context = (("rpm_std", "rpm_std", "rpm"), ("speed_std", "speed_std", "km/h"), ("accel_pedal_mean_std", "pedal_std", "pp"))
    return checks + [Check("5-S3", f"context_{x}_120s", always, c(w[x]), "trips0.5", m[limit], m[limit] * 0.1, u) for x, limit, u in context]


def trip_weighted_quantiles(folded: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """(measure, q): quantiles in which each trip weighs the same, of a table (measure, trip_id, v, c, n, first) of counts; linear between neighbouring distinct values.

    ``n`` counts all of the trip's values, ``first`` is true in one row a measure and trip: no row is dealt out by trip.
    """
    count = folded.groupBy("measure").agg(F.count_if("first").alias("trips"))
    w = folded.groupBy("measure", "v").agg(F.sum(F.col("c") / F.col("n")).alias("w"))
    w = running_totals(w.join(F.broadcast(count), "measure").withColumn("w", F.col("w") / F.col("trips")), ("measure", "v"), {"to": F.col("w")}, by=("measure",))  # a row a measure
    near = w.groupBy("measure").agg(
        F.max("v").alias("top"),
        *[f(F.struct("v", "to"), F.when(side, F.col("to"))).alias(f"{n}{i}") for i, q in enumerate(quantiles) for n, f, side in (("lo", F.max_by, F.col("to") <= q), ("hi", F.min_by, F.col("to") >= q))],
    )

    def at(i: int, q: float) -> Column:
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        between = lo["v"] + (hi["v"] - lo["v"]) * (q - lo["to"]) / (hi["to"] - lo["to"])
        return F.when(hi.isNull(), F.col("top")).when(lo.isNull() | (hi["to"] == lo["to"]), hi["v"]).otherwise(between)

    return near.select("measure", F.array(*[at(i, q) for i, q in enumerate(quantiles)]).alias("q"))


def rederived(samples: DataFrame, checks: list[Check]) -> DataFrame:
    """Audit rows of ``checks`` in one pass over the samples: each gives a count by check, trip and distinct value, from which all statistics come, those of ranks by ranges.

    Checks of extremes give a row a trip. Where ``samples`` are dealt out by trip, counts are taken where they are. A check that no sample meets is INCOMPLETE.
    """
    names = dict(enumerate(checks))  # a number each: texts would be most of what is dealt out
    ends_only = ("min", "max", "above")
    value, none = lambda c: c.value.cast("double"), F.lit(None).cast("double")
    cells = [
        F.when(F.coalesce(c.mask, F.lit(False)) & c.value.isNotNull(), F.struct(F.lit(n).alias("measure"), (none if c.statistic in ends_only else value(c)).alias("v"), (value(c) if c.statistic in ends_only else none).alias("x"))) for n, c in names.items()
    ]
    long = samples.select("trip_id", F.explode(F.array(*cells)).alias("m")).where("m is not null").select("trip_id", "m.*")
    folded = long.groupBy("measure", "trip_id", "v").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
    own = Window.partitionBy("measure", "trip_id").orderBy("v")
    folded = written(folded.withColumns({"n": F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "first": F.row_number().over(own) == 1}), "measures")
    of = lambda *kinds: [n for n, c in names.items() if c.statistic.rstrip("0123456789.") in kinds]
    share = lambda n: float(names[n].statistic.lstrip("qtrips"))
    pick = lambda df, chosen, shares: df.select("measure", F.element_at(F.create_map(*[F.lit(x) for n in chosen for x in (n, shares.index(share(n)))]), F.col("measure")).alias("i"), "q").select("measure", F.get("q", F.col("i")).alias("now"))
    ends = folded.groupBy("measure").agg(F.sum("c").alias("n"), F.min(F.coalesce("v", "low")).alias("low"), F.max(F.coalesce("v", "high")).alias("high"))
    parts = [ends.where(F.col("measure").isin(of("min"))).select("measure", F.col("low").alias("now")), ends.where(F.col("measure").isin(of("max", "above"))).select("measure", F.col("high").alias("now"))]
    if chosen := of("q"):
        shares = sorted({share(n) for n in chosen})
        parts.append(pick(exact_quantiles(folded.where(F.col("measure").isin(chosen)), ("measure",), "v", tuple(shares), times="c"), chosen, shares))
    if chosen := of("trips"):
        shares = sorted({share(n) for n in chosen})
        parts.append(pick(trip_weighted_quantiles(folded.where(F.col("measure").isin(chosen)), tuple(shares)), chosen, shares))
    if chosen := of("medians"):
        own = exact_quantiles(folded.where(F.col("measure").isin(chosen)), ("measure", "trip_id"), "v", (0.5,), times="c").select("measure", F.col("q")[0].alias("m"))
        parts.append(exact_quantiles(own, ("measure",), "m", (0.5,)).select("measure", F.col("q")[0].alias("now")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rows = samples.sparkSession.createDataFrame([(n, c.sub_check, c.param, float(c.frozen), float(c.tolerance), c.unit, c.statistic == "above", c.least) for n, c in names.items()], "measure int, sub_check string, param string, frozen double, tolerance double, unit string, above boolean, least long")
    j = rows.join(found, "measure", "left").join(ends.select("measure", "n"), "measure", "left")  # a row a check
    n = F.coalesce("n", F.lit(0))
    now = F.when(n >= F.col("least"), F.col("now"))
    sound = F.when(F.col("above"), F.col("frozen") > now).otherwise(F.abs(now - F.col("frozen")) <= F.col("tolerance"))
    status = F.when(now.isNull(), "INCOMPLETE").when(sound, "PASS").otherwise("FAIL")
    return j.select("sub_check", "param", "frozen", now.alias("rederived"), "tolerance", "unit", status.alias("status"), n.cast("long").alias("n"))


# -- without each trip in turn ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mergeable:
    """A statistic of states that merge: aggregates of a trip's rows by name, each with the function that merges two, and the value of merged ones."""

    states: dict[str, tuple[Column, Callable]]
    value: Column


@dataclass(frozen=True)
class Quantile:
    value: str
    q: float


def mean_of(value: str) -> Mergeable:
    return Mergeable({"s": (F.sum(value), F.sum), "n": (F.count(value), F.sum)}, F.try_divide(F.col("s"), F.col("n")))


def maximum_of(value: str) -> Mergeable:
    return Mergeable({"m": (F.max(value), F.max)}, F.col("m"))


def slope_of(y: str, x: str) -> Mergeable:
    """Slope of the least-squares line of ``y`` on ``x``, of rows that hold both."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    states = {"n": F.count(a), "sx": F.sum(a), "sy": F.sum(b), "sxx": F.sum(a * a), "sxy": F.sum(a * b)}
    c = F.col
    return Mergeable({n: (s, F.sum) for n, s in states.items()}, F.try_divide(c("n") * c("sxy") - c("sx") * c("sy"), c("n") * c("sxx") - c("sx") * c("sx")))


def merged_without_own(states: DataFrame, key: str, merges: dict[str, Callable]) -> DataFrame:
    """(key, states): for each row the states of all other rows merged: those before it and those after it, so that nothing is ever taken off again.

    Rows are dealt out by ranges of ``key``, which must be unique; whole ranges before and after come from a table of one row a range.
    """
    dealt = written(states.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy("_range").agg(*[f(n).alias(n) for n, f in merges.items()])
    till = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    up, down = till(Window.orderBy("_range")), till(Window.orderBy(F.desc("_range")))  # a row a range
    whole = whole.select("_range", *[f(n).over(w).alias(f"_{side}_{n}") for n, f in merges.items() for side, w in (("up", up), ("down", down))])
    inside = {"a": till(Window.partitionBy("_range").orderBy(key)), "z": till(Window.partitionBy("_range").orderBy(F.desc(key)))}
    j = dealt.join(F.broadcast(whole), "_range")
    j = j.withColumns({f"_{side}_{n}": f(n).over(w) for n, f in merges.items() for side, w in inside.items()})

    def merge(n: str, f: Callable) -> Column:
        parts = [F.col(f"_{side}_{n}") for side in ("up", "a", "z", "down")]
        if f is F.sum:
            return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))
        return (F.greatest if f is F.max else F.least)(*parts)

    return j.select(key, *[merge(n, f).alias(n) for n, f in merges.items()])


def _values_at(folded: DataFrame, ranks: DataFrame) -> DataFrame:
    """(rank, v): the value that holds each of the distinct ``ranks``, of a table (v, to) of values and the last rank that each holds."""
    u = folded.select(F.col("to").alias("pos"), F.lit(0).alias("kind"), "v").unionByName(ranks.select(F.col("rank").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v")))
    u = written(u.repartitionByRange("pos").withColumn("_range", F.spark_partition_id()), "places")
    first = u.where("kind = 0").groupBy("_range").agg(F.min_by("v", "pos").alias("first"))
    every = u.select("_range").distinct().join(first, "_range", "left")
    later = F.last("first", True).over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    here = Window.partitionBy("_range").orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    j = u.withColumn("near", F.last("v", True).over(here)).join(F.broadcast(every.select("_range", later.alias("later"))), "_range")
    return j.where("kind = 1").select(F.col("pos").alias("rank"), F.coalesce("near", "later").alias("v"))


def _quantile_without_own(df: DataFrame, s: Quantile) -> DataFrame:
    """(trip_id, value): the quantile over the rows of all other trips.

    In the order of all rows, the k-th of the others is preceded by those of the trip's own rows that have fewer than k others before them, so
    its place among all rows is k plus their number: one numbering of all values serves every trip.
    """
    folded = df.where(F.col(s.value).isNotNull()).groupBy("trip_id", F.col(s.value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    at = running_totals(folded, ("v", "trip_id"), {"to": F.col("c")})
    at = written(running_totals(at, ("v", "trip_id"), {"own": F.col("c")}, by=("trip_id",)), "numbered")
    n = at.groupBy("trip_id").agg(F.sum("c").alias("n"))
    whole = at.agg(F.sum("c").alias("all"))
    n = n.crossJoin(F.broadcast(whole)).where("all > n")  # one row
    place = (F.col("all") - F.col("n") - 1) * F.lit(s.q)
    n = n.withColumns({"lo": (F.floor(place) + 1).cast("long"), "hi": (F.ceil(place) + 1).cast("long"), "part": place - F.floor(place)})
    j = at.join(n, "trip_id")
    before = lambda k_: F.coalesce(F.sum(F.when(F.col("to") - F.col("own") < F.col(k_), F.col("c"))), F.lit(0))
    want = j.groupBy("trip_id", "lo", "hi", "part").agg(before("lo").alias("b_lo"), before("hi").alias("b_hi"))
    want = want.select("trip_id", "part", (F.col("lo") + F.col("b_lo")).alias("lo"), (F.col("hi") + F.col("b_hi")).alias("hi"))
    want = written(want, "places")
    values = _values_at(at.select("v", "to"), want.select(F.col("lo").alias("rank")).unionByName(want.select(F.col("hi").alias("rank"))).distinct())
    values = written(values, "values")
    low, high = (values.select(F.col("rank").alias(c), F.col("v").alias(f"v_{c}")) for c in ("lo", "hi"))
    out = want.join(low, "lo").join(high, "hi")
    return out.select("trip_id", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("part")).alias("value"))


def leave_one_out(df: DataFrame, statistic: Mergeable | Quantile, frozen: float, tolerance: float = 0.0) -> DataFrame:
    """(left_out_trip, recalculated, deviation, deviation_pct, passes) of any statistic, without each trip in turn.

    No trip is compared with another: mergeable states take one row a trip, quantiles one numbering of all values. A tolerance of 0 passes all.
    A statistic that the other trips do not have is null; with a single trip there are no rows of a quantile.
    """
    if isinstance(statistic, Quantile):
        out = _quantile_without_own(df, statistic)
    else:
        states = df.groupBy("trip_id").agg(*[s.alias(n) for n, (s, _) in statistic.states.items()])
        out = merged_without_own(states, "trip_id", {n: f for n, (_, f) in statistic.states.items()}).select("trip_id", statistic.value.alias("value"))
    d = F.col("value") - F.lit(float(frozen))
    passes = F.abs(d) <= tolerance if tolerance > 0 else F.lit(True)
    return out.select(F.col("trip_id").alias("left_out_trip"), F.col("value").alias("recalculated"), d.alias("deviation"), (d / frozen * 100 if frozen else F.lit(0.0)).alias("deviation_pct"), passes.alias("passes"))


# -- alarm threshold ----------------------------------------------------------------------------------------------

METRICS = ("macro_f1", "micro_f1", "exact_hit_rate", "healthy_false_positive_rate")


def threshold_metrics(records: DataFrame, types: tuple[str, ...], also: DataFrame | None = None) -> DataFrame:
    """Metrics at every candidate threshold: 0, each score, the double next above 1, and those of ``also`` (threshold).

    ``records``: expected (null: healthy), anomaly_type, risk_score. A record alarms at a threshold that its score reaches. Counts by score are
    summed from the top by ranges of scores: no record meets a threshold. A null score never alarms.
    """
    want, said = F.col("expected"), F.col("anomaly_type")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = {f"tp{i}": count((want == t) & (said == t)) for i, t in enumerate(types)} | {f"al{i}": count(said == t) for i, t in enumerate(types)}
    sums |= {"hits": count(want == said), "alarms": count(want.isNull())}
    totals = records.agg(*[count(want == t).alias(f"all{i}") for i, t in enumerate(types)], F.count(want).alias("injected"), count(want.isNull()).alias("healthy_runs"))
    by = records.where("risk_score is not null").groupBy(F.col("risk_score").alias("threshold")).agg(*[c.alias(n) for n, c in sums.items()])
    ends = records.sparkSession.createDataFrame([(0.0,), (float(np.nextafter(1.0, np.inf)),)], "threshold double")
    for more in (ends, also) if also is not None else (ends,):
        by = by.unionByName(more.select("threshold"), allowMissingColumns=True)
    by = by.groupBy("threshold").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums]).withColumn("down", -F.col("threshold"))
    m = running_totals(by, ("down",), {n: F.col(n) for n in sums}).crossJoin(F.broadcast(totals))  # one row
    c, n = F.col, range(len(types))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = [part(2 * c(f"tp{i}"), c(f"al{i}") + c(f"all{i}")) for i in n]
    tp, al, every = (sum((c(f"{x}{i}") for i in n), F.lit(0)) for x in ("tp", "al", "all"))
    precision, recall = part(tp, al), part(tp, every)
    return m.select(
        "threshold", (sum(f1, F.lit(0.0)) / len(types)).alias("macro_f1"), part(2 * precision * recall, precision + recall).alias("micro_f1"), part(c("hits"), c("injected")).alias("exact_hit_rate"),
        part(c("alarms"), c("healthy_runs")).alias("healthy_false_positive_rate"), c("alarms").alias("healthy_alarms"), "healthy_runs",
    )


def choose_threshold(metrics: DataFrame, target: float = 0.10) -> DataFrame:
    """The row of the best macro F1 among those whose false alarm rate is at most ``target``; ties: more exact hits, fewer alarms, the lower line."""
    order = F.struct("macro_f1", "exact_hit_rate", -F.col("healthy_false_positive_rate"), -F.col("threshold"))
    best = metrics.where(F.col("healthy_false_positive_rate") <= target).agg(F.max_by(F.struct(*metrics.columns), order).alias("b"))
    return best.where("b is not null").select("b.*")


def calibrated_threshold(records: DataFrame, types: tuple[str, ...], target: float = 0.10) -> DataFrame:
    """(part, threshold, metrics): the threshold chosen on ``calibration`` records, and how it does on them, on the ``hold_out`` and on all.

    ``records`` have a ``segment_id``, a ``role`` and an ``error``; those of the primary role without an error count, and every third segment is held out.
    """
    primary = records.where((F.col("role") == "primary") & F.col("error").isNull())
    segments = numbered(primary.select("segment_id").distinct(), ("segment_id",), "place").select("segment_id", (F.col("place") % 3 == 0).alias("held_out"))
    primary = written(primary.join(segments, "segment_id"), "primary")
    chosen = written(choose_threshold(threshold_metrics(primary.where("not held_out"), types), target).select("threshold"), "threshold")
    parts = {"calibration": primary.where("not held_out"), "hold_out": primary.where("held_out"), "full": primary}
    rows = [threshold_metrics(p, types, chosen).join(F.broadcast(chosen), "threshold").select(F.lit(n).alias("part"), "*") for n, p in parts.items()]  # one row
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
