"""Cleaning of raw recordings: names, bounds, duplicates, segments, regular bins, short gaps and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k

CONDITIONS = ("Frei", "Normal", "Stau")


def parse_filename(name: Column) -> Column:
    """Struct of a name such as ``2018-03-01_Seat_Leon_RT_S_Normal_x.csv``: date, brand, model, origin, destination, sequence, condition, extension.

    The condition label splits what follows the destination: before it a sequence, after it an extension; all null where it is missing.
    """
    p = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_")
    rest = F.slice(p, 6, F.greatest(F.size(p) - 5, F.lit(0)))
    at = F.array_max(F.array(*[F.array_position(rest, c) for c in CONDITIONS]))
    ok = (F.size(p) >= 6) & (at > 0)
    part = lambda i: F.when(ok, F.get(p, F.lit(i)))
    none_if_empty = lambda a: F.when(ok & (F.size(a) > 0), F.array_join(a, "_"))
    return F.struct(
        F.when(ok, F.try_to_date(p[0])).alias("date"), part(1).alias("brand"), part(2).alias("model"), part(3).alias("origin"), part(4).alias("destination"),
        none_if_empty(F.slice(rest, 1, F.greatest(at.cast("int") - 1, F.lit(0)))).alias("sequence"), F.when(ok, F.get(rest, at.cast("int") - 1)).alias("condition"),
        none_if_empty(F.slice(rest, F.greatest(at.cast("int") + 1, F.lit(1)), 100)).alias("extension"),
    )


def date_of(name: Column) -> Column:
    """``parse_filename(name)["date"]`` by one pattern: rows by the million ask for nothing else."""
    return F.try_to_date(F.regexp_extract(name, rf"(?s)^([^_]*)(?:_[^_]*){{4}}_(?:[^_]*_)*?(?:{'|'.join(CONDITIONS)})(?:_.*)?(?:\.[A-Za-z0-9]+)?$", 1))


def local_time(date: Column, time: Column) -> Column:
    """Local date and HH:MM:SS[.fff] as they are written; null where either is malformed or missing."""
    return F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), time))


def to_utc(date: Column, time: Column, zone: str) -> Column:
    """Local date and HH:MM:SS[.fff] to UTC; null where malformed."""
    return F.to_utc_timestamp(local_time(date, time), zone)


def local_time_exists(utc: Column, local: Column, zone: str) -> Column:
    """False for a local time that the switch to summer time leaves out: the way back does not meet it."""
    return F.from_utc_timestamp(utc, zone) == local


def local_time_ambiguous(utc: Column, local: Column, zone: str) -> Column:
    """True for a local time that occurs twice: one hour earlier or later, in UTC, shows it too."""
    hour = F.expr("INTERVAL 1 HOUR")
    return (F.from_utc_timestamp(utc - hour, zone) == local) | (F.from_utc_timestamp(utc + hour, zone) == local)


def hard_invalid(col: str, bounds: dict = k.BOUNDS) -> Column:
    lo, hi, *_ = bounds[col]
    return F.coalesce(~F.col(col).between(lo, hi), F.lit(False))


def suspicious(col: str, bounds: dict = k.BOUNDS, sentinels: dict = k.SENTINELS) -> Column:
    """Outside the range of normal work, or a reading that stands for a broken sensor."""
    _, _, lo, hi, _ = bounds[col]
    odd = ~F.col(col).between(lo, hi)
    return F.coalesce(odd | F.col(col).isin(*sentinels[col]) if sentinels.get(col) else odd, F.lit(False))


def cross_field() -> dict[str, Column]:
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    return {
        "rpm_zero_while_speed_positive": yes((c("rpm") == 0) & (c("speed") > 0)),
        "maf_zero_while_rpm_positive": yes((c("maf") == 0) & (c("rpm") > 0)),
        "coolant_below_zero_in_warm_ambient": yes((c("coolant_temp") < 0) & (c("ambient_temp") > 5)),
    }


def quality_flags(columns: tuple[str, ...], bounds: dict = k.BOUNDS) -> Column:
    """Flags of a sample in fixed order: per field hard_invalid and suspicious, then the cross-field rules; OK if none."""
    cells = []
    for s in columns:
        cells += [F.when(hard_invalid(s, bounds), f"{s}_hard_invalid"), F.when(suspicious(s, bounds) & ~hard_invalid(s, bounds), f"{s}_suspicious")]
    cells += [F.when(v, n) for n, v in cross_field().items()]
    flags = F.array_compact(F.array(*cells))
    return F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, "|"))


def dedupe_last(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of rows with equal keys, the last in ``order``, which must be unique: one aggregate, no sort of a hot key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def resample(df: DataFrame, value: str, seconds: int = 1) -> DataFrame:
    """(trip_id, segment, bin): last value that is not null, number of samples and of values. ``us`` is the time in microseconds."""
    df = df.withColumn("bin", F.floor(F.col("us") / (seconds * 1_000_000)).cast("long"))
    return df.groupBy("trip_id", "segment", "bin").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("us", "event_id"))).alias(value), F.count("*").alias("samples"), F.count(value).alias("observed")
    )


def densify(bins: DataFrame, keys: tuple[str, ...] = ("trip_id", "segment")) -> DataFrame:
    """A row for each bin between a segment's first and last; bins without a sample have nulls.

    Each row brings the empty bins up to the next one with it, so nothing is joined, and rows come up where the segment's own rows are.
    """
    rest, at = [c for c in bins.columns if c not in (*keys, "bin")], F.col("bin")
    after = F.lead("bin").over(Window.partitionBy(*keys).orderBy("bin")) - 1
    df = bins.withColumn("_to", F.greatest(at, after)).select("*", F.explode(F.sequence("bin", "_to")).alias("_bin"))
    return df.select(*keys, F.col("_bin").alias("bin"), *[F.when(F.col("_bin") == at, F.col(c)).alias(c) for c in rest])


def fill_all_short(df: DataFrame, strategies: dict[str, str], longest: int = 2, keys: tuple[str, ...] = ("trip_id", "segment"), at: str = "bin") -> DataFrame:
    """``df`` with ``<col>_filled`` and ``<col>_is_imputed`` for each column of ``strategies``. Only whole runs of at most ``longest`` nulls are filled.

    Interpolation in time needs a value on both sides; forward fill one before; ``retain`` fills nothing. One sort serves all columns:
    what comes next is looked for in the row and the ``longest`` after it, since the end of a run that is filled lies no further.
    """
    back = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*keys).orderBy(at).rowsBetween(0, longest)
    place, mark = F.col("_place"), lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), place.alias("place"), F.col(c).alias("v")))
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(at)))
    made = {"_rows_on": F.count(F.lit(1)).over(on)}
    for c in strategies:
        made |= {f"_{c}_0": F.last(mark(c), True).over(back), f"_{c}_1": F.first(mark(c), True).over(on)}
    old = [c for c in df.columns if c != "_place"]
    df = df.withColumns(made)
    out = []
    for c, strategy in strategies.items():
        v, before, after = F.col(c), F.col(f"_{c}_0"), F.col(f"_{c}_1")
        # the place after the run: that of the next value, or the one after the last row, if either is in reach
        end = F.coalesce(after["place"], F.when(F.col("_rows_on") <= longest, place + F.col("_rows_on")))
        short = v.isNull() & (end - F.coalesce(before["place"], F.lit(0)) - 1 <= longest)
        if strategy == "interpolation":
            new = before["v"] + (after["v"] - before["v"]) * (F.col(at) - before["at"]) / (after["at"] - before["at"])
        else:
            new = before["v"] if strategy == "forward_fill" else F.lit(None).cast("double")
        filled = F.coalesce(v, F.when(short, new))
        out += [filled.alias(f"{c}_filled"), (v.isNull() & filled.isNotNull()).alias(f"{c}_is_imputed")]
    return df.select(*old, *out)


def fill_short(df: DataFrame, col: str, longest: int = 2, strategy: str = "interpolation", keys: tuple[str, ...] = ("trip_id", "segment"), at: str = "bin") -> DataFrame:
    """``fill_all_short`` of one column."""
    return fill_all_short(df, {col: strategy}, longest, keys, at)


def dense_filled(bins: DataFrame, strategies: dict[str, str], longest: int = 2, keys: tuple[str, ...] = ("trip_id", "segment"), at: str = "bin", also: dict[str, Column] | None = None) -> DataFrame:
    """``densify`` and ``fill_all_short`` in one sort: the columns of ``strategies`` filled in place, with ``<col>_is_imputed``; other columns are null in empty bins.
    ``also`` are columns, or windows over the keys in order of the bins, that the empty bins after a row share with it.

    A run that is filled ends no further than ``longest`` bins away, so no more rows than that before and after a bin are looked at, and
    each row brings them to the empty bins that follow it.
    """
    w, back, on, also = Window.partitionBy(*keys).orderBy(at), range(1, longest + 1), range(1, longest + 1), also or {}
    row, here = F.struct(at, *strategies), F.col("_bin") == F.col(at)
    df = bins.withColumns({f"_b{i}": F.lag(row, i).over(w) for i in back} | {f"_a{i}": F.lead(row, i).over(w) for i in on} | also)
    df = df.select("*", F.explode(F.sequence(F.col(at), F.greatest(F.col(at), F.col(f"_a1.{at}") - 1))).alias("_bin"))
    last = F.coalesce(*[F.col(f"_a{i}.{at}") for i in reversed(on)], F.col(at))  # beyond reach where it is not the segment's last bin
    out = []
    for c, strategy in strategies.items():
        own = F.when(here, F.col(c))
        before = F.coalesce(F.when(~here, F.col(c)), *[F.col(f"_b{i}.{c}") for i in back])
        before_at = F.coalesce(F.when(~here & F.col(c).isNotNull(), F.col(at)), *[F.when(F.col(f"_b{i}.{c}").isNotNull(), F.col(f"_b{i}.{at}")) for i in back])
        after = F.coalesce(*[F.col(f"_a{i}.{c}") for i in on])
        after_at = F.coalesce(*[F.when(F.col(f"_a{i}.{c}").isNotNull(), F.col(f"_a{i}.{at}")) for i in on])
        short = F.coalesce(after_at, last + 1) - before_at - 1 <= longest
        if strategy == "interpolation":
            new = before + (after - before) * (F.col("_bin") - before_at) / (after_at - before_at)
        else:
            new = before if strategy == "forward_fill" else F.lit(None).cast("double")
        out += [F.coalesce(own, F.when(short, new)).alias(c), (own.isNull() & F.when(short, new).isNotNull()).alias(f"{c}_is_imputed")]
    rest = [c for c in bins.columns if c not in (*keys, at, *strategies, *also)]
    return df.select(*keys, *also, F.col("_bin").alias(at), *[F.when(here, F.col(c)).alias(c) for c in rest], *out)


def discover(files: DataFrame) -> DataFrame:
    """``files`` (file, start) with ``trip_id``, numbered by (start, name); generated outputs are left out. A row a file, so one sort is fine."""
    kept = files.where(~F.col("file").rlike(r"(?i)_(?:clean|report|quality)\.csv$"))
    return kept.withColumn("trip_id", F.format_string("trip_%04d", F.row_number().over(Window.orderBy("start", "file"))))


def read_raw(spark, paths: list[str], aliases: dict[str, list[str]], encoding: str = "UTF-8") -> DataFrame:
    """Raw CSV files, read as text by header variant, renamed through ``aliases`` and unioned; ``file`` and ``row`` tell the origin."""
    out = None
    for path in paths:
        df = spark.read.option("header", True).option("encoding", encoding).csv(path)
        known = {a.strip().lower(): name for name, names in aliases.items() for a in names}
        cols = [F.col(f"`{c}`").alias(known[n]) for c in df.columns if (n := c.replace("Â", "").replace("﻿", "").strip().lower()) in known]
        df = df.select(*cols, F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def coercion_failures(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, failures): texts that are not null and no number."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), 1)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "failures")
