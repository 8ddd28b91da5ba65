"""Comparison of forecasts: errors by signal, relations between signals, and which of two is better."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mae(df: DataFrame, signals: tuple[str, ...], suffix: str) -> DataFrame:
    """(signal, mae, points) over rows where truth and ``<signal><suffix>`` are known; one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.abs(F.col(f"{s}{suffix}") - F.col(s)).alias("e")) for s in signals]))
    return df.select(cells.alias("c")).select("c.*").groupBy("signal").agg(F.avg("e").alias("mae"), F.count("e").alias("points"))


def correlation_error(df: DataFrame, signals: tuple[str, ...], suffix: str, keys: tuple[str, ...]) -> DataFrame:
    """(pairs, error): mean over windows and pairs of signals of the gap between their correlation as forecast and as measured; pairs without variance are left out."""
    def correlation(x, y):  # null without variance, where corr itself would fail
        known = x.isNotNull() & y.isNotNull()
        x, y = F.when(known, x), F.when(known, y)
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-12, spread))

    aggs = []
    for a, b in combinations(signals, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        guess = correlation(F.when(both, F.col(f"{a}{suffix}")), F.when(both, F.col(f"{b}{suffix}")))
        aggs.append(F.abs(guess - correlation(F.col(a), F.col(b))).alias(f"{a}_{b}"))
    w = df.groupBy(*keys).agg(*aggs)
    e = w.select(F.explode(F.array(*[F.col(f"{a}_{b}") for a, b in combinations(signals, 2)])).alias("e")).where("e is not null")
    return e.agg(F.count("*").alias("pairs"), F.avg("e").alias("error"))


def compare(first: DataFrame, second: DataFrame, least_pct: float = 5.0, least_signals: int = 4) -> DataFrame:
    """Per signal the improvement of ``second`` over ``first`` in percent, and, on every row, whether it is a clear one overall."""
    j = first.select("signal", F.col("mae").alias("before"), F.col("points").alias("n")).join(second.select("signal", F.col("mae").alias("after")), "signal")
    j = j.withColumn("improvement_pct", F.when(F.col("before") == 0, 0.0).otherwise((F.col("before") - F.col("after")) / F.col("before") * 100))
    whole = j.agg(F.sum(F.col("before") * F.col("n")).alias("b"), F.sum(F.col("after") * F.col("n")).alias("a"), F.count_if(F.col("improvement_pct") >= 0).alias("better"))
    clear = ((F.col("b") - F.col("a")) / F.col("b") * 100 >= least_pct) & (F.col("better") >= least_signals)
    return j.crossJoin(F.broadcast(whole)).select("signal", "before", "after", "improvement_pct", F.coalesce(clear, F.lit(False)).alias("clear_improvement"))  # one row
