"""Continuity blocks, strict windows, runs and edges: partitioned by (trip, segment), never over the whole table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("trip_id", "segment_id", "row_in_segment")


def segment_window() -> Window:
    return Window.partitionBy("trip_id", "segment_id").orderBy("row_in_segment")


def quality_valid(signals: Iterable[str]) -> Column:
    """A value is there and its three flags are explicitly false; a null flag is invalid."""
    valid = F.lit(True)
    for s in signals:
        valid = valid & F.col(s).isNotNull()
        for flag in FLAGS:
            valid = valid & F.col(f"{s}_{flag}").eqNullSafe(F.lit(False))
    return valid


FLAGS = ("is_imputed", "is_suspicious", "had_hard_invalid_source")


def with_quality(df: DataFrame) -> DataFrame:
    """``df`` with ``<signal>_ok`` in the place of the three flags of each signal: decided once, and rows get narrow before they are dealt out and sorted."""
    signals = [c.removesuffix("_is_imputed") for c in df.columns if c.endswith("_is_imputed")]
    gone = {f"{s}_{f}" for s in signals for f in FLAGS}
    return df.select(*[c for c in df.columns if c not in gone], *[quality_valid([s]).alias(f"{s}_ok") for s in signals])


def ok(signals: Iterable[str]) -> Column:
    """All of the signals are quality valid, in a table of ``with_quality``."""
    out = F.lit(True)
    for s in signals:
        out = out & F.col(f"{s}_ok")
    return out


def bits(conditions: Iterable[Column]) -> Column:
    """A long with a bit for each of up to 63 ``conditions`` that is true: one cell a row where a window would carry many."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def bit(mask: Column | str, i: int) -> Column:
    return (F.col(mask) if isinstance(mask, str) else mask).bitwiseAND(F.lit(1 << i).cast("long")) != 0


def without(mask: str, gone: Column) -> Column:
    """The bits of ``mask`` that are not set in ``gone``; a null takes none away."""
    return F.col(mask).bitwiseAND(F.bitwise_not(F.coalesce(gone, F.lit(0).cast("long"))))


def blocks_of(df: DataFrame, valid: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with, for each named condition, ``<name>``, the number of the continuity block inside its segment, and ``<name>_start``, the row that begins it.

    Both are null on rows where the condition is not true. A row goes on with its predecessor if both
    hold, rows differ by one and times by one second. Blocks are unbroken runs of a segment's rows, so
    every window over a block is a window over the segment that looks back no further than the block's
    start: one exchange and one sort serve all blocks of all signals. ``also`` are windows over the segment
    that ask for no block: they are worked out in the same pass.
    """
    w, row, old, also = segment_window(), F.col("row_in_segment"), df.columns, also or {}
    df = df.select(*[c for c in old if c not in valid and c not in {f"{n}_start" for n in valid}], bits(valid.values()).alias("_held"))
    df = df.withColumns({f"_{c}_before": F.lag(c).over(w) for c in ("row_in_segment", "t", "_held")} | also)
    step = (row - F.col("_row_in_segment_before") == 1) & (F.col("t") - F.col("_t_before") == 1)
    df = df.withColumn("_begins", without("_held", F.when(step, F.col("__held_before"))))
    marks = {f"_{n}_no": F.sum(bit("_begins", i).cast("int")).over(w) for i, n in enumerate(valid)} | {f"_{n}_from": F.max(F.when(bit("_begins", i), row)).over(w) for i, n in enumerate(valid)}
    df = df.withColumns(marks)
    made = [F.when(bit("_held", i), F.col(f"_{n}_{x}")).alias(out) for i, n in enumerate(valid) for x, out in (("no", n), ("from", f"{n}_start"))]
    return df.select(*[c for c in df.columns if not c.startswith("_") or c in old or c in also], *made)


def local_blocks(df: DataFrame, valid: Column, block: str = "block") -> DataFrame:
    """``blocks_of`` one condition."""
    return blocks_of(df, {block: valid})


def whole_blocks(df: DataFrame) -> DataFrame:
    """``df`` with ``block``, unbroken rows whatever their quality: those of ``whole_block`` where ``df`` has them."""
    if "whole_block_start" in df.columns:
        return df.withColumns({"block": F.col("whole_block"), "block_start": F.col("whole_block_start")})
    return local_blocks(df, F.lit(True), "block")


def depth(block: str = "block") -> Column:
    """Rows of the block before this one; null outside blocks."""
    return F.col("row_in_segment") - F.col(f"{block}_start")


def back(value: Column | str, n: int = 1, block: str = "block") -> Column:
    """``value`` of the block's row n before; null where the block does not reach so far."""
    return F.when(depth(block) >= n, F.lag(value, n).over(segment_window()))


def ahead(value: Column | str, n: int = 1, block: str = "block") -> Column:
    """``value`` of the block's row n after; null where the block does not reach so far."""
    return F.when(F.lead(f"{block}_start", n).over(segment_window()) == F.col(f"{block}_start"), F.lead(value, n).over(segment_window()))


def continuity(df: DataFrame, valid: Column) -> DataFrame:
    """Keys with ``valid``, ``continues``, ``break_reason`` and ``block_id``, numbered over the whole table in time order.

    The order of segments comes from a table of one row a segment, the only one that is sorted whole.
    """
    df = df.select(*KEYS, "t", F.coalesce(valid, F.lit(False)).alias("valid"))
    before = F.lag(F.struct("row_in_segment", "t", "valid")).over(segment_window())
    df = df.withColumn("b", before)
    rows_on, time_on = F.col("row_in_segment") - F.col("b.row_in_segment") == 1, F.col("t") - F.col("b.t") == 1
    df = df.withColumn("continues", F.coalesce(F.col("valid") & F.col("b.valid") & rows_on & time_on, F.lit(False)))
    starts = (F.col("valid") & ~F.col("continues")).cast("int")
    df = df.withColumn("local", F.sum(starts).over(segment_window()))
    whole = Window.orderBy("first_t", "trip_id", "segment_id")
    segments = df.groupBy("trip_id", "segment_id").agg(F.min("t").alias("first_t"), F.max("local").alias("n"))
    segments = segments.select(
        "trip_id", "segment_id", (F.sum("n").over(whole) - F.col("n")).alias("offset"), F.lag("trip_id").over(whole).alias("trip_before")
    )
    df = df.join(segments, ["trip_id", "segment_id"])
    reason = (
        F.when(~F.col("valid"), "invalid_sample")
        .when(F.col("continues"), "continuous")
        .when(F.col("b").isNull() & F.col("trip_before").isNull(), "dataset_start")
        .when(F.col("b").isNull() & (F.col("trip_before") != F.col("trip_id")), "trip_boundary")
        .when(F.col("b").isNull(), "segment_boundary")
        .when(~F.col("b.valid"), "previous_sample_invalid")
        .when(~rows_on, "row_not_consecutive")
        .otherwise("timestamp_not_consecutive")
    )
    return df.select(*KEYS, "valid", "continues", reason.alias("break_reason"), F.when(F.col("valid"), F.col("local") + F.col("offset")).alias("block_id"))


def strict_window(n: int, block: str = "block") -> Column:
    """The row is the n-th of its block, or later."""
    return F.coalesce(depth(block) >= n - 1, F.lit(False))


def strict_span(n: int, block: str = "block") -> Column:
    """The block holds the row n seconds before: n + 1 end points."""
    return F.coalesce(depth(block) >= n, F.lit(False))


def neighbourhood(before: int, after: int, block: str = "block") -> Column:
    """The block holds so many rows before and after the row."""
    return F.coalesce((depth(block) >= before) & (F.lead(f"{block}_start", after).over(segment_window()) == F.col(f"{block}_start")), F.lit(False))


def runs_of(df: DataFrame, conditions: dict[str, Column], block: str = "block") -> DataFrame:
    """``df`` with, for each named condition, ``<name>_start`` and ``<name>_start_t``: row and time at which the run of true that the row is in began; null elsewhere.

    A run never leaves its block, in which rows and seconds go on by one. Runs of all conditions come from one lag and one window.
    """
    w, row, old = segment_window(), F.col("row_in_segment"), df.columns
    df = df.withColumn("_held", F.when(F.col(block).isNotNull(), bits(conditions.values())).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_before", F.lag("_held").over(w))
    df = df.withColumn("_begins", without("_held", F.when(depth(block) >= 1, F.col("_before"))))
    df = df.withColumns({f"_{n}_from": F.max(F.when(bit("_begins", i), row)).over(w) for i, n in enumerate(conditions)})
    value = {n: (F.col(f"_{n}_from"), F.col("t") - (row - F.col(f"_{n}_from"))) for n in conditions}
    made = [F.when(bit("_held", i), x).alias(f"{n}_{out}") for i, n in enumerate(conditions) for x, out in zip(value[n], ("start", "start_t"))]
    return df.select(*old, *made)


def true_runs(df: DataFrame, condition: Column, run: str = "run", block: str = "block") -> DataFrame:
    """``df`` with ``run``, the number within the block of the unbroken run of true ``condition``, and ``run_start``, its first row; null elsewhere."""
    w, old, start = segment_window(), [c for c in df.columns if c not in (run, f"{run}_start")], F.col(f"{run}_start")
    df = runs_of(df.select(*old), {run: condition}, block)
    begins = F.coalesce(start == F.col("row_in_segment"), F.lit(False)).cast("int")
    df = df.withColumn("_all", F.sum(begins).over(w))
    df = df.withColumn("_earlier", F.max(F.when(depth(block) == 0, F.col("_all") - begins)).over(w))
    return df.select(*old, F.when(start.isNotNull(), F.col("_all") - F.col("_earlier")).alias(run), f"{run}_start")


def persistence(df: DataFrame, condition: Column, n: int, out: str = "persists", block: str = "block") -> DataFrame:
    """``df`` with ``out``: the condition has held for n samples of the block by now."""
    old = [c for c in df.columns if c != out]
    df = runs_of(df.select(*old), {"_lasting": condition}, block)
    return df.select(*old, F.coalesce(F.col("row_in_segment") - F.col("_lasting_start") >= n - 1, F.lit(False)).alias(out))


def rising_edge(condition: Column, block: str = "block") -> Column:
    """True where the condition turns from false to true inside a block."""
    return F.coalesce(F.col(block).isNotNull() & condition & (back(condition, 1, block) == F.lit(False)), F.lit(False))


def segment_by_gap(df: DataFrame, seconds: float, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """``df`` with ``segment``, from 1: a new one begins where the time since the row before, in microseconds, exceeds ``seconds``."""
    w = Window.partitionBy("trip_id").orderBy(*order)
    gap = F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(0))
    df = df.withColumn("breaks", (gap > int(seconds * 1_000_000)).cast("int"))
    return df.withColumn("segment", (F.sum("breaks").over(w) + 1).cast("long")).drop("breaks")


def longest_runs(df: DataFrame, condition: Column) -> DataFrame:
    """Per trip and segment: the longest run of true over the rows given, in order; rows left out before do not break a run."""
    held = F.coalesce(condition, F.lit(False))
    df = df.withColumn("held", held).withColumn("other", F.sum((~held).cast("int")).over(segment_window()))
    runs = df.where("held").groupBy("trip_id", "segment_id", "other").agg(F.count("*").alias("n"))
    best = runs.groupBy("trip_id", "segment_id").agg(F.max("n").alias("longest"))
    return df.select("trip_id", "segment_id").distinct().join(best, ["trip_id", "segment_id"], "left").select("trip_id", "segment_id", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def first_window(df: DataFrame, condition: Column, length: int, block: str = "block") -> DataFrame:
    """One row a trip: the earliest run of ``length`` true samples, (trip_id, segment_id, first_row, n)."""
    runs = true_runs(df, condition, "run", block).where("run is not null")
    runs = runs.groupBy("trip_id", "segment_id", block, "run").agg(F.min("row_in_segment").alias("first_row"), F.min("t").alias("first_t"), F.count("*").alias("n"))
    found = runs.where(F.col("n") >= length)
    return found.groupBy("trip_id").agg(F.min_by(F.struct("segment_id", "first_row", "n"), F.struct("first_t", "segment_id")).alias("w")).select("trip_id", "w.*")


def step_of(df: DataFrame) -> DataFrame:
    """(trip_id, segment_id, first_row, gap_seconds): a row a segment, with the seconds from the end of the segment before it in time; null for the first and where negative."""
    w = Window.orderBy("start", "trip_id", "segment_id")  # a row a segment
    s = df.groupBy("trip_id", "segment_id").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.min("row_in_segment").alias("first_row"))
    gap = F.col("start") - F.lag("end").over(w)
    return s.select("trip_id", "segment_id", "first_row", F.when(gap >= 0, gap).cast("double").alias("gap_seconds"))
