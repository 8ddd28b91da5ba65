"""Evaluation of detections, calibration audits, stability diagnostics and perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions.physics import clip, draw
from roadlens.operators.ranks import exact_quantiles, numbered, running_total
from roadlens.sources.scratch import written


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_metrics(records: DataFrame, types: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 per type (and ``by``), from columns ``expected`` and ``predicted``; one pass."""
    t = records.withColumn("type", F.explode(F.array(*[F.lit(x) for x in types])))
    hit, want = F.coalesce(F.col("predicted") == F.col("type"), F.lit(False)), F.coalesce(F.col("expected") == F.col("type"), F.lit(False))
    a = t.groupBy(*by, "type").agg(F.count_if(hit & want).alias("tp"), F.count_if(hit & ~want).alias("fp"), F.count_if(~hit & want).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.withColumns({"precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn)})


def confusion(records: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return records.groupBy("expected").pivot("predicted", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def threshold_sweep(records: DataFrame, thresholds: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Macro F1 and the false alarm rate of healthy records at each threshold; ``thresholds`` is a small table, checked by the caller."""
    j = records.crossJoin(F.broadcast(thresholds)).withColumn("predicted", F.when(F.col("risk_score") >= F.col("threshold"), F.col("anomaly_type")).otherwise("no_alarm"))
    m = classification_metrics(j, types, ("threshold",)).groupBy("threshold").agg(F.avg("f1").alias("macro_f1"))
    h = j.where("expected is null").groupBy("threshold").agg(F.avg((F.col("predicted") != "no_alarm").cast("double")).alias("fpr"))
    return m.join(h, "threshold", "left")


def weighted_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """Quantile in which each trip weighs the same: cumulative weight over sorted values, linear between neighbours. Values are folded first and ranked by ranges."""
    df = df.where(F.col(value).isNotNull())
    n = df.groupBy("trip_id").agg(F.count("*").alias("n"))
    trips = n.agg(F.count("*").alias("trips"))
    w = df.join(n, "trip_id").crossJoin(F.broadcast(trips)).groupBy(F.col(value).alias("v")).agg(F.sum(1 / (F.col("n") * F.col("trips"))).alias("w"))
    near = running_total(w, ("v",), F.col("w"), "c").agg(
        F.max_by(F.struct("v", "c"), F.when(F.col("c") <= q, F.col("c"))).alias("lo"), F.min_by(F.struct("v", "c"), F.when(F.col("c") >= q, F.col("c"))).alias("hi"), F.max("v").alias("top")
    )
    lo, hi = F.col("lo"), F.col("hi")
    between = lo["v"] + (hi["v"] - lo["v"]) * (q - lo["c"]) / (hi["c"] - lo["c"])
    return near.select(F.when(hi.isNull(), F.col("top")).when(lo.isNull() | (hi["c"] == lo["c"]), hi["v"]).otherwise(between).alias("quantile"))


def leave_one_out_median(df: DataFrame, value: str, frozen: float, tolerance: float) -> DataFrame:
    """Median of the trips' medians without each trip in turn, against the frozen value.

    Leaving out rank r moves the middle by one place, so the three values about the middle tell all medians.
    """
    m = exact_quantiles(df, ("trip_id",), value, (0.5,)).select("trip_id", F.col("q")[0].alias("m"))
    m = written(numbered(m, ("m", "trip_id"), "r"), "medians")
    n = F.col("n")
    at = lambda place: F.max(F.when(F.col("r") == place, F.col("m")))
    half = F.floor(n / 2)  # of n - 1 values left, those at (n - 1) / 2 or about it
    middle = m.crossJoin(F.broadcast(m.agg(F.count("*").alias("n")))).groupBy("n").agg(at(half).alias("low"), at(half + 1).alias("mid"), at(half + 2).alias("high"))
    out = m.crossJoin(F.broadcast(middle)).where("n > 1")
    even = F.when(F.col("r") <= half, F.col("mid")).otherwise(F.col("low"))  # n even: an odd number is left
    odd = F.when(F.col("r") <= half, (F.col("mid") + F.col("high")) / 2).when(F.col("r") == half + 1, (F.col("low") + F.col("high")) / 2).otherwise((F.col("low") + F.col("mid")) / 2)
    out = out.select(F.col("trip_id").alias("left_out_trip"), F.when(n % 2 == 0, even).otherwise(odd).alias("recalculated"))
    d = F.col("recalculated") - frozen
    return out.withColumns({"deviation": d, "deviation_pct": d / frozen * 100 if frozen else F.lit(0.0), "passes": F.abs(d) <= tolerance})


def bootstrap_mean(df: DataFrame, value: str, iterations: int, seed: str = "boot") -> DataFrame:
    """Mean, deviation and 95 % interval of the mean over trips drawn with replacement; draws come from hashes, so they repeat."""
    per = df.groupBy("trip_id").agg(F.avg(value).alias("m")).where("m is not null")
    per = written(numbered(per, ("trip_id",), "i").withColumn("i", F.col("i") - 1), "trips")
    n = per.agg(F.count("*").alias("n"))
    draws = per.crossJoin(F.broadcast(n)).select(F.col("i").alias("k"), "n", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("it"))
    draws = draws.withColumn("pick", draw(F.lit(seed), F.col("it"), F.col("k")) % F.col("n"))
    means = draws.join(per.select(F.col("i").alias("pick"), "m"), "pick").groupBy("it").agg(F.avg("m").alias("mean"))
    return means.agg(
        F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"), F.count("*").alias("iterations")
    )


def grid_runs(longest: DataFrame, candidates: tuple[int, ...]) -> DataFrame:
    """For each persistence candidate: trips whose longest run reaches it."""
    c = longest.groupBy("trip_id").agg(F.max("longest").alias("longest"))
    c = c.withColumn("candidate", F.explode(F.array(*[F.lit(x) for x in candidates])))
    return c.groupBy("candidate").agg(F.count("*").alias("trips"), F.count_if(F.col("longest") >= F.col("candidate")).alias("triggered"), F.max("longest").alias("longest"))


def fit_line(df: DataFrame, x: str, y: str, lo: float, hi: float, by: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x``, both clipped, per ``by``."""
    cx, cy = clip(F.col(x), lo, hi), F.col(y)
    return df.groupBy(by).agg(F.regr_slope(cy, cx).alias("slope"), F.regr_intercept(cy, cx).alias("intercept"), F.regr_r2(cy, cx).alias("r2"))


def audit(checks: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``checks`` (check, frozen, rederived) with the relative deviation and PASS, FAIL or INCOMPLETE."""
    rel = F.abs(F.col("rederived") - F.col("frozen")) / F.greatest(F.abs(F.col("frozen")), F.lit(1e-12))
    return checks.withColumn("deviation", rel).withColumn("verdict", F.when(rel.isNull(), "INCOMPLETE").when(rel <= tolerance, "PASS").otherwise("FAIL"))


def inject(df: DataFrame, signal: str, strategy: str, held: Column, p: dict, order: Window) -> Column:
    """``signal`` changed where ``held`` is true; null stays null except where a constant, a ramp or another signal replaces it.

    ``order`` runs over the rows of one window, in time; for ``suppress_step`` over the segment.
    """
    x = F.col(signal)
    if strategy == "suppress_step":
        before = F.lag(signal).over(order)
        near = F.coalesce(*[F.when(F.lag(held, o).over(order) if o else held, before if o == 0 else F.lag(signal, o + 1).over(order)) for o in (2, 1, 0)][::-1])
        return F.coalesce(near, x)
    new = {
        "set_constant": lambda: F.lit(float(p["value"])),
        "add_offset": lambda: x + p["offset"],
        "multiply": lambda: x * p["factor"],
        "freeze_to_first": lambda: F.first(signal).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "linear_ramp": lambda: F.lit(float(p["start"])) + (F.row_number().over(order) - 1) * (p["rate_per_min"] / 60.0),
        "cap_max": lambda: F.when(x.isNotNull(), F.least(x, F.lit(float(p["value"])))),
        "relative_offset": lambda: F.col(p["reference"]) + p["offset"],
    }[strategy]()
    return F.when(held, new).otherwise(x)
