"""Raw recordings from text files to cleaned samples: read, name, parse, coerce, dedupe, bound, segment, resample, fill and flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.functions import constants as k
from roadlens.operators.cleaning import cross_field, date_of, dense_filled, discover, hard_invalid, local_time, local_time_ambiguous, local_time_exists, suspicious, to_utc
from roadlens.operators.continuity import bit, bits

ZONE, GAP_S, LONGEST_FILL_S = "Europe/Berlin", 3.0, 2
#: Header names of each field, without the unit signs that encodings break.
ALIASES = {
    "time": ("time",), "coolant_temp": ("engine coolant temperature [c]",), "rpm": ("engine rpm [rpm]",), "speed": ("vehicle speed sensor [km/h]",), "map": ("intake manifold absolute pressure [kpa]",),
    "intake_temp": ("intake air temperature [c]",), "maf": ("air flow rate from mass flow sensor [g/s]",), "tps": ("absolute throttle position [%]",), "ambient_temp": ("ambient air temperature [c]",), "accel_pedal_d": ("accelerator pedal position d [%]",), "accel_pedal_e": ("accelerator pedal position e [%]",),
}


def normal_header(name: str) -> str:
    """A header as it is compared: degree signs, broken ones too, taken out, white space folded, in lower case."""
    return " ".join(name.replace("﻿", "").replace("Â", "").replace("°", "").split()).lower()


def canonical(raw: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """``raw`` with its known columns renamed; columns that no alias names are left out, except ``file``. Two columns of one field are an error."""
    names = {a: field for field, own in aliases.items() for a in own}
    known = [(c, names[normal_header(c)]) for c in raw.columns if normal_header(c) in names]
    twice = sorted({f for _, f in known if sum(g == f for _, g in known) > 1})
    if twice:
        raise ValueError(f"more than one column for {', '.join(twice)}")
    return raw.select("file", *[F.col(f"`{c}`").alias(f) for c, f in known])


def read_recordings(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """All recordings below ``folder``, as text, from one directory ``file=<name>`` each or from files of many, with a last column ``file``; a row that does not fit the header fails the job. ``row`` rises with the rows of a file."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", file string"
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(folder)
    return df.withColumn("row", F.monotonically_increasing_id())


def with_times(raw: DataFrame, zone: str = ZONE, *, strict: bool = False) -> DataFrame:
    """``raw`` with ``us``, microseconds of UTC from the date in the file's name and the local time, and ``time_fault`` where there is none.

    A time is ``malformed``, or ``nonexistent`` where the clock skips it, or ``ambiguous`` where it comes twice: none of these
    is guessed, ``us`` is null. With ``strict`` the first such row ends the job.
    """
    date, utc, local = F.col("_date"), F.col("_utc"), F.col("_local")
    df = raw.withColumn("_date", date_of(F.col("file")))  # a column of its own: what refers to it does not parse the name again
    df = df.withColumns({"_utc": to_utc(date, F.col("time"), zone), "_local": local_time(date, F.col("time"))})
    fault = F.when(utc.isNull() | date.isNull(), "malformed").when(~local_time_exists(utc, local, zone), "nonexistent").when(local_time_ambiguous(utc, local, zone), "ambiguous")
    df = df.withColumn("time_fault", fault)
    told = F.concat(F.lit("a local time is "), F.col("time_fault"), F.lit(" in "), F.col("file"))
    df = df.withColumn("us", F.when(F.col("time_fault").isNull(), F.unix_micros(utc)).when(F.lit(strict), F.raise_error(told).cast("long")))
    return df.drop("_date", "_utc", "_local")


def time_faults(raw: DataFrame) -> DataFrame:
    """(file, time_fault, rows): what ``with_times`` could not place, by file."""
    kinds = ("malformed", "nonexistent", "ambiguous")
    counts = raw.groupBy("file").agg(*[F.count_if(F.col("time_fault") == x).alias(x) for x in kinds])
    return counts.unpivot(["file"], list(kinds), "time_fault", "rows").where("rows > 0")


def coercion_failures(raw: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(file, field, failures): texts that are there and are no numbers, by file and field; a row for each pair that has some."""
    counts = raw.groupBy("file").agg(*[F.count_if(F.col(f).isNotNull() & F.col(f).try_cast("double").isNull()).alias(f) for f in fields])
    return counts.unpivot(["file"], list(fields), "field", "failures").where("failures > 0")


def trips_of(raw: DataFrame) -> DataFrame:
    """(file, start, rows, malformed, trip_id): recordings numbered by first time, then name. A row a file."""
    files = raw.groupBy("file").agg(F.min("us").alias("start"), F.count("*").alias("rows"), F.count_if(F.col("us").isNull()).alias("malformed"))
    return discover(files)


def clean(raw: DataFrame, trips: DataFrame, fields: tuple[str, ...], *, gap_s: float = GAP_S, longest: int = LONGEST_FILL_S, bounds: dict = k.BOUNDS) -> DataFrame:
    """One row a second of each segment of each trip, with the fields, their flags and the row's ``quality_flags``, those of rules across fields last.

    Of rows with one time the last of the file counts. Values out of physical bounds are taken out, and
    their second is flagged. A gap of over ``gap_s`` starts a segment. A second holds the last value that is
    there; a whole run of at most ``longest`` empty seconds is filled, by the field's own rule. Rows without
    a time are left out, texts that are no numbers are empty. Every step is partitioned by file: where ``raw`` is dealt out by it
    (``written_by``) no row is dealt out again, and a task holds a bucket. One sort tells the last of each time and the segments,
    another the seconds; rows are numbers from the start, with the values taken out as one bit a field.
    """
    number = lambda f: F.col(f).try_cast("double")
    df = raw.where("us is not null").select("file", "us", "row", *[number(f).alias(f) for f in fields])
    df = df.select("file", "us", "row", *[F.when(~hard_invalid(f, bounds), F.col(f)).alias(f) for f in fields], bits([hard_invalid(f, bounds) for f in fields]).alias("bad"))
    w = Window.partitionBy("file").orderBy("us", "row")
    df = df.withColumns({"_breaks": F.coalesce(F.col("us") - F.lag("us").over(w) > int(gap_s * 1_000_000), F.lit(False)).cast("int"), "_next": F.lead("us").over(w)})
    df = df.withColumn("segment", (F.sum("_breaks").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("long"))
    df = df.where("_next is null or _next <> us").withColumn("bin", F.floor(F.col("us") / 1_000_000).cast("long"))
    cells = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("us"))).alias(f) for f in fields]
    df = df.groupBy("file", "segment", "bin").agg(*cells, F.bit_or("bad").alias("bad"), F.count("*").alias("samples"))
    df = df.withColumn("observed", sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)))
    df = df.join(trips.select("file", "trip_id").hint("shuffle_hash"), "file")
    keys = ("file", "segment")
    first = F.min("bin").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    df = dense_filled(df, {f: bounds[f][4] for f in fields}, longest, keys, also={"trip_id": F.col("trip_id"), "first": first})
    bad = F.coalesce("bad", F.lit(0).cast("long"))
    df = df.withColumns({f"{f}_had_hard_invalid_source": bit(bad, i) for i, f in enumerate(fields)} | {f"{f}_is_suspicious": suspicious(f, bounds) for f in fields})
    told = [F.when(F.col(f"{f}_{flag}"), f"{f}:{name}") for f in fields for flag, name in (("had_hard_invalid_source", "hard_invalid_source"), ("is_suspicious", "suspicious"))]
    told += [F.when(rule, name) for name, rule in cross_field().items()] if {"rpm", "speed", "maf", "coolant_temp", "ambient_temp"} <= set(fields) else []
    any_of = lambda flag: reduce(lambda a, b: a | b, [F.col(f"{f}_{flag}") for f in fields])
    number = F.col("segment").cast("string")
    return df.select(
        "trip_id", F.concat("trip_id", F.lit("_seg_"), F.when(F.col("segment") < 1000, F.lpad(number, 3, "0")).otherwise(number)).alias("segment_id"), (F.col("bin") - F.col("first") + 1).cast("int").alias("row_in_segment"), F.col("bin").alias("t"),
        F.coalesce("samples", F.lit(0)).cast("long").alias("source_sample_count"), F.coalesce("observed", F.lit(0)).cast("int").alias("observed_sensor_count"), *fields, *[f"{f}_{x}" for f in fields for x in ("is_imputed", "is_suspicious", "had_hard_invalid_source")],
        any_of("is_imputed").alias("is_imputed_any"), any_of("is_suspicious").alias("is_suspicious_any"), any_of("had_hard_invalid_source").alias("had_hard_invalid_source_any"),
        F.concat_ws("|", *told).alias("quality_flags"),
    )


def flag_counts(cleaned: DataFrame) -> DataFrame:
    """(flag, rows): the flags of a cleaned table, taken apart."""
    each = F.explode(F.array_remove(F.split("quality_flags", r"\|"), ""))
    return cleaned.select(each.alias("flag")).groupBy("flag").agg(F.count("*").alias("rows"))
