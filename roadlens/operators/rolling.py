"""Strict rolling windows, slopes, latches and fills over continuity blocks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.operators.continuity import back, depth, segment_window, step_of


def _full(n: int, block: str | None, value: Column) -> Column:
    """``value`` over the last n rows of the segment, which are the block's own from its n-th row on; as it is where no block is named."""
    return F.when(depth(block) >= n - 1, value) if block else value


def rolling_std(col: str, n: int, block: str | None = "block") -> Column:
    """Sample standard deviation of the last n samples of the block; null before the n-th."""
    return _full(n, block, F.stddev_samp(col).over(segment_window().rowsBetween(-(n - 1), 0)))


def rolling_range(col: str, n: int, block: str | None = "block") -> Column:
    w = segment_window().rowsBetween(-(n - 1), 0)
    return _full(n, block, F.max(col).over(w) - F.min(col).over(w))


def slope(col: str, block: str = "block") -> Column:
    """First difference over elapsed seconds inside the block."""
    return (F.col(col) - back(col, 1, block)) / (F.col("t") - back("t", 1, block))


def trapezoid(col: str, seconds: int = 180, block: str | None = "block") -> Column:
    """Integral over the last ``seconds``, of seconds + 1 end points of one block."""
    return _full(seconds + 1, block, F.sum(col).over(segment_window().rowsBetween(-seconds, 0)) - (F.col(col) + F.lag(col, seconds).over(segment_window())) / 2)


def span_rate(col: str, seconds: int = 180, block: str | None = "block") -> Column:
    """Change over the last ``seconds``, per minute."""
    return _full(seconds + 1, block, (F.col(col) - F.lag(col, seconds).over(segment_window())) / (seconds / 60))


def centred_mean(col: str, reach: int = 1) -> Column:
    return F.avg(col).over(segment_window().rowsBetween(-reach, reach))


def step_seconds(most: int = 5) -> Column:
    """Seconds since the row before; 1 where that is none or not within (0, most]."""
    d = F.col("t") - F.lag("t").over(segment_window())
    return F.when((d > 0) & (d <= most), d).otherwise(1).cast("double")


def running_sum(value: Column) -> Column:
    return F.sum(F.coalesce(value, F.lit(0.0))).over(segment_window().rowsBetween(Window.unboundedPreceding, 0))


def latch(condition: Column) -> Column:
    """Once true, true to the end of the segment."""
    return F.max(F.coalesce(condition, F.lit(False))).over(segment_window().rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(col: str) -> Column:
    return F.last(col, ignorenulls=True).over(segment_window().rowsBetween(Window.unboundedPreceding, 0))


def interpolate_both(col: str) -> Column:
    """Linear by position between the values about a null; the nearest value at both ends of a segment."""
    row = F.when(F.col(col).isNotNull(), F.col("row_in_segment"))
    # the next value is the last one in backward order: a growing frame, where one that shrinks would be read anew for each row
    past, to_come = segment_window(), Window.partitionBy("trip_id", "segment_id").orderBy(F.desc("row_in_segment"))
    v0, r0, v1, r1 = (F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (past, to_come) for x in (col, row))
    between = v0 + (v1 - v0) * (F.col("row_in_segment") - r0) / (r1 - r0)
    return F.coalesce(col, between, v0, v1)


def segment_gaps(df: DataFrame) -> DataFrame:
    """One row a segment: its start less the end of the segment before it in time; null for the first and where negative."""
    return step_of(df).drop("first_row")


def null_runs(df: DataFrame, col: str) -> DataFrame:
    """Per trip and segment: number of runs of nulls and the longest."""
    seen = F.count(col).over(segment_window().rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("seen", seen).where(F.col(col).isNull()).groupBy("trip_id", "segment_id", "seen").agg(F.count("*").alias("n"))
    return runs.groupBy("trip_id", "segment_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def tumble_rows(df: DataFrame, rows: int = 608) -> DataFrame:
    """``df`` with ``window_no`` and ``step``: whole windows of so many rows of a segment, the rest dropped."""
    at = F.row_number().over(segment_window()) - 1
    df = df.withColumn("window_no", F.floor(at / rows).cast("int")).withColumn("step", (at % rows).cast("int"))
    n = F.count("*").over(Window.partitionBy("trip_id", "segment_id", "window_no"))
    return df.withColumn("rows_in_window", n).where(F.col("rows_in_window") == rows).drop("rows_in_window")


def slide_rows(df: DataFrame, length: int, stride: int, values: str) -> DataFrame:
    """Per segment and start (0, stride, ...): the ``values`` of ``length`` rows, and how many are not null."""
    at = F.row_number().over(segment_window()) - 1
    w = segment_window().rowsBetween(0, length - 1)
    df = df.select("trip_id", "segment_id", at.alias("start"), F.count("*").over(w).alias("n"), F.count(values).over(w).alias("observed"), F.avg(values).over(w).alias("mean"))
    return df.where((F.col("n") == length) & (F.col("start") % stride == 0)).drop("n")


def zscores(df: DataFrame, col: str, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with ``z``: standardised by the population deviation of its window; deviations below 1e-6 count as 1."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(col).over(w)
    return df.withColumn("z", (F.col(col) - F.avg(col).over(w)) / F.when(sd < 1e-6, 1.0).otherwise(sd))
