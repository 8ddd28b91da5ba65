"""Audit of a cleaning run: reports by file, segment and field, of the whole run, and the quality of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.operators.cleaning import cross_field, hard_invalid
from roadlens.operators.continuity import bit, bits

FLAGS = ("is_imputed", "is_suspicious", "had_hard_invalid_source")


def _long(fields: tuple[str, ...], cells: dict) -> Column:
    """One row a field: a struct of its name and ``cells``, each a function of the field's name."""
    return F.explode(F.array(*[F.struct(F.lit(f).alias("field"), *[c(f).alias(n) for n, c in cells.items()]) for f in fields]))


def raw_files(raw: DataFrame, fields: tuple[str, ...], *, bounds: dict = k.BOUNDS) -> DataFrame:
    """A row a file, from its raw rows that have a time.

    ``input_rows``; ``deduplicated_rows``, distinct times; ``duplicate_rows``, rows whose time comes more than once;
    ``max_gap_seconds`` between distinct times (0 if there is one only); ``monotonic``, whether no row is earlier than
    the row before it in the file; and by field ``<field>_failures``, texts that are no numbers, of all rows, and ``<field>_invalid``,
    values out of physical bounds, of the last row of each time. One sort by time and row serves all, rows being in order of time if their numbers rise
    in it; where ``raw`` is dealt out by file, no row is dealt out again.
    """
    number = lambda f: F.col(f).try_cast("double")
    df = raw.where("us is not null").select("file", "us", "row", *[number(f).alias(f) for f in fields], bits([F.col(f).isNotNull() & number(f).isNull() for f in fields]).alias("_failed"))
    df = df.select("file", "us", "row", "_failed", bits([hard_invalid(f, bounds) for f in fields]).alias("_invalid"))
    w = Window.partitionBy("file").orderBy("us", "row")
    df = df.withColumns({"_us": F.lag("us").over(w), "_row": F.lag("row").over(w), "_next": F.lead("us").over(w)})
    again, last = F.coalesce(F.col("_us") == F.col("us"), F.lit(False)), F.coalesce(F.col("_next") != F.col("us"), F.lit(True))
    return df.groupBy("file").agg(
        F.count("*").alias("input_rows"), F.count_if(last).alias("deduplicated_rows"), F.count_if(again | ~last).alias("duplicate_rows"), F.coalesce(F.max((F.col("us") - F.col("_us")) / 1_000_000), F.lit(0.0)).alias("max_gap_seconds"),
        (~F.bool_or(F.coalesce(F.col("row") < F.col("_row"), F.lit(False)))).alias("monotonic"), *[F.count_if(bit("_failed", i)).alias(f"{f}_failures") for i, f in enumerate(fields)], *[F.count_if(last & bit("_invalid", i)).alias(f"{f}_invalid") for i, f in enumerate(fields)],
    )


def missing_runs(cleaned: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(trip_id, field, missing, runs, longest): empty cells of a trip and their unbroken runs in order of time, across its segments.

    A cell's place in its run is told by the last row that holds a value, so one window serves all fields. One bit a field is dealt out and sorted.
    """
    w = Window.partitionBy("trip_id").orderBy("t", "segment_id").rowsBetween(Window.unboundedPreceding, 0)
    held = cleaned.select("trip_id", "t", "segment_id", bits([F.col(f).isNotNull() for f in fields]).alias("held")).withColumn("n", F.row_number().over(w))
    place = {f: F.col("n") - F.coalesce(F.max(F.when(bit("held", i), F.col("n"))).over(w), F.lit(0)) for i, f in enumerate(fields)}
    places = held.select("trip_id", *[x.alias(f) for f, x in place.items()])
    runs = {"missing": lambda f: F.count_if(F.col(f) > 0), "runs": lambda f: F.count_if(F.col(f) == 1), "longest": lambda f: F.max(F.col(f).cast("long"))}
    wide = places.groupBy("trip_id").agg(*[c(f).alias(f"{f}_{n}") for f in fields for n, c in runs.items()])
    return wide.select("trip_id", _long(fields, {n: lambda f, n=n: F.col(f"{f}_{n}") for n in runs}).alias("c")).select("trip_id", "c.*")


def file_report(files: DataFrame, trips: DataFrame, cleaned: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row a file: its trip, rows in, without repeated times and out, segments, largest gap, order, failed texts and removed values."""
    made = cleaned.groupBy("trip_id").agg(F.count("*").alias("output_rows"), F.count_distinct("segment_id").alias("segments"))
    total = lambda kind: sum((F.col(f"{f}_{kind}") for f in fields), F.lit(0)).alias(kind)
    df = files.join(trips.select("file", "trip_id"), "file").join(made, "trip_id", "left")
    return df.select("file", "trip_id", "input_rows", "deduplicated_rows", "duplicate_rows", F.coalesce("output_rows", F.lit(0)).alias("output_rows"), F.coalesce("segments", F.lit(0)).alias("segments"), "max_gap_seconds", "monotonic", total("failures"), total("invalid"))


def file_field_report(files: DataFrame, trips: DataFrame, cleaned: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(file, field, failures, invalid, missing, runs, longest): what each field of a file lost in cleaning, and what stays empty."""
    cells = _long(fields, {"failures": lambda f: F.col(f"{f}_failures"), "invalid": lambda f: F.col(f"{f}_invalid")})
    lost = files.join(trips.select("file", "trip_id"), "file").select("file", "trip_id", cells.alias("c")).select("file", "trip_id", "c.*")
    return lost.join(missing_runs(cleaned, fields), ["trip_id", "field"]).drop("trip_id")


def segment_report(cleaned: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A row a segment: rows in and out, first and last second, samples a second, flags over all fields and counts of the rules across fields."""
    flags = {"imputed": "is_imputed", "suspicious": "is_suspicious", "hard_invalid_bins": "had_hard_invalid_source"}
    each = lambda flag: sum((F.col(f"{f}_{flag}").cast("long") for f in fields), F.lit(0))
    n = "source_sample_count"
    return cleaned.groupBy("trip_id", "segment_id").agg(
        F.sum(n).alias("input_rows"), F.count("*").alias("output_rows"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min(n).alias("samples_min"), F.max(n).alias("samples_max"),
        *[F.sum(each(flag)).alias(name) for name, flag in flags.items()], *[F.count_if(rule).alias(name) for name, rule in cross_field().items()],
    )


def global_report(files: DataFrame, cleaned: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(measure, field, value) of the whole run; ``field`` is null for measures of rows.

    Rows whose (trip, segment, second) comes more than once, and steps inside a segment that are not one second, are found by
    their keys: both are 0 after a sound run.
    """
    of_files = files.agg(F.count("*").alias("files"), F.sum("input_rows").alias("input_rows"), *[F.sum(f"{f}_invalid").alias(f"physical_invalid_removed:{f}") for f in fields])
    # flags of one kind as one number a row: rows are counted by it, and cells from the few numbers there are
    kinds = {flag: [(f"{flag}:{f}", F.col(f"{f}_{flag}")) for f in fields] + [(f"rows:{flag}_any", F.col(f"{flag}_any"))] for flag in FLAGS} | {"missing": [(f"missing:{f}", F.col(f).isNull()) for f in fields]}
    cells = F.array(*[F.struct(F.lit(i).alias("kind"), bits([c for _, c in of]).alias("mask")) for i, of in enumerate(kinds.values())])
    masks = cleaned.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.mask").agg(F.count("*").alias("n"))
    hits = [F.struct(F.lit(name).alias("m"), F.when((F.col("kind") == i) & bit("mask", j), F.col("n")).otherwise(0).alias("value")) for i, of in enumerate(kinds.values()) for j, (name, _) in enumerate(of)]
    hits += [F.struct(F.lit("output_rows").alias("m"), F.when(F.col("kind") == 0, F.col("n")).otherwise(0).alias("value"))]
    none = masks.sparkSession.sql("SELECT 0 AS kind, 0L AS mask, 0L AS n")  # so that nothing is missing from the report of an empty run
    of_rows = masks.unionByName(none).select(F.explode(F.array(*hits)).alias("c")).groupBy("c.m").agg(F.sum("c.value").alias("value"))
    w, t = Window.partitionBy("trip_id", "segment_id").orderBy("t"), F.col("t")
    steps = cleaned.select("trip_id", "segment_id", "t").withColumns({"_before": F.lag("t").over(w), "_after": F.lead("t").over(w)})
    by_segment = steps.groupBy("trip_id", "segment_id").agg(F.count_if((t == F.col("_before")) | F.coalesce(t == F.col("_after"), F.lit(False))).alias("twice"), F.count_if(t - F.col("_before") != 1).alias("off"))
    by_trip = by_segment.groupBy("trip_id").agg(F.count("*").alias("segments"), F.sum("twice").alias("twice"), F.sum("off").alias("off"))
    of_keys = by_trip.agg(F.count("*").alias("trips"), F.sum("segments").alias("segments"), F.sum("twice").alias("duplicate_key_rows"), F.sum("off").alias("steps_not_one_second"))
    parts = []
    for df in (of_files, of_keys):
        df = df.select([F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in df.columns])
        parts.append(df.unpivot([], [F.col(f"`{c}`") for c in df.columns], "m", "value"))
    out = parts[0].unionByName(parts[1]).unionByName(of_rows)
    name = F.split("m", ":")
    is_field = F.get(name, F.lit(1)).isin(*fields)
    return out.select(F.when(is_field, name[0]).otherwise(F.regexp_replace("m", "^rows:", "rows_")).alias("measure"), F.when(is_field, F.get(name, F.lit(1))).alias("field"), "value")


def _moments(df: DataFrame, fields: tuple[str, ...]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample deviation of each field over all rows: one row on the driver."""
    row = df.agg(*[F.avg(f).alias(f"{f}_m") for f in fields], *[F.stddev_samp(f).alias(f"{f}_s") for f in fields]).first()
    return {f: (row[f"{f}_m"], row[f"{f}_s"]) for f in fields}


def _far(f: str, moments: dict, z: float) -> Column:
    m, s = moments[f]
    return F.coalesce(F.abs(F.col(f) - F.lit(m)) / F.lit(s) > z, F.lit(False)) if s else F.lit(False)


def field_matrix(df: DataFrame, fields: tuple[str, ...], *, z: float = 3.0) -> DataFrame:
    """A row a field: extremes, empty cells and their share, values over ``z`` deviations from the mean of all, imputed and suspicious cells.

    Two passes: means and deviations of all fields, then all counts in one aggregate. A field of one value, or of none, has no outliers.
    """
    moments = _moments(df, fields)
    cells = {"min": F.min, "max": F.max, "missing": lambda f: F.count_if(F.col(f).isNull()), "rows": lambda f: F.count("*"), "outliers": lambda f: F.count_if(_far(f, moments, z)), "imputed": lambda f: F.count_if(f"{f}_is_imputed"), "suspicious": lambda f: F.count_if(f"{f}_is_suspicious")}
    wide = df.agg(*[F.struct(*[c(f).alias(n) for n, c in cells.items()]).alias(f) for f in fields])
    out = wide.select(_long(fields, {n: lambda f, n=n: F.col(f)[n] for n in cells}).alias("c")).select("c.*")
    return out.select("field", "min", "max", "missing", F.try_divide("missing", "rows").alias("missing_rate"), "outliers", "imputed", "suspicious")


def outliers_by_trip(df: DataFrame, fields: tuple[str, ...], *, z: float = 3.0, top: int = 5) -> DataFrame:
    """(field, place, trip_id, outliers): the ``top`` trips of each field with most values over ``z`` deviations from the mean of all; of equal counts the smaller trip comes first."""
    moments = _moments(df, fields)
    counts = df.groupBy("trip_id").agg(*[F.count_if(_far(f, moments, z)).alias(f) for f in fields])
    counts = counts.unpivot(["trip_id"], list(fields), "field", "outliers").where("outliers > 0")
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("outliers"), "trip_id"))
    return counts.withColumn("place", place).where(F.col("place") <= top)


def jumps(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(field, jumps, segments): steps between successive rows of a segment larger than a field's limit, and the segments that have some."""
    w = Window.partitionBy("trip_id", "segment_id").orderBy("row_in_segment")
    steps = df.select("trip_id", "segment_id", *[F.coalesce(F.abs(F.col(f) - F.lag(f).over(w)) > x, F.lit(False)).alias(f) for f, x in limits.items()])
    by = steps.groupBy("trip_id", "segment_id").agg(*[F.count_if(f).alias(f) for f in limits]).unpivot(["trip_id", "segment_id"], list(limits), "field", "n")
    return by.groupBy("field").agg(F.sum("n").alias("jumps"), F.count_if(F.col("n") > 0).alias("segments"))
