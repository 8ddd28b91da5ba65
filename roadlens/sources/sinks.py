"""Sinks: tables by trip, single-file exports and key-signal rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet, replaced as a whole by the commit protocol; partitioned by ``by``."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def export_csv(df: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Text export in key order, for people: the only place where a whole table is sorted. Many files, in order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def key_signal_rows(risks: DataFrame, columns: tuple[str, ...] = ("feature", "value", "unit")) -> DataFrame:
    """A row per key signal of each record, with the chosen columns and NORMAL, ABNORMAL or Unknown against its reference range."""
    s = risks.select("trip_id", "window_id", F.explode("key_signals").alias("s"))
    return s.select("trip_id", "window_id", *[F.col(f"s.{c}").alias(c) for c in columns], signal_status(F.col("s.value"), F.col("s.reference_range")).alias("status"))


def signal_status(value: Column, reference: Column) -> Column:
    known = value.isNotNull() & (F.size(reference) == 2)
    return F.when(~F.coalesce(known, F.lit(False)), "Unknown").when(value.between(F.get(reference, F.lit(0)), F.get(reference, F.lit(1))), "NORMAL").otherwise("ABNORMAL")


def read_model_output(spark, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """Records of model-output JSON: single ones, or the windows of a batch envelope. A file is one document, or with ``lines`` one a line."""
    raw = spark.read.schema(f"{schema}, windows array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))}>>").json(path, multiLine=not lines)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    one = raw.where("windows is null").select(*names)
    return one.unionByName(raw.where("windows is not null").select(F.explode("windows").alias("w")).select("w.*"))


POINTER = "_current"  # the file that names the published version


def publish(df: DataFrame, table: str, by: tuple[str, ...] = ()) -> str:
    """Replaces the table at ``table`` (a folder) as a whole, and returns the folder of the new version.

    The rows are written to a folder of their own first; only then does a pointer file name it, in one step: it is made
    under another name and put in place by a rename. A writer that fails before leaves the old version as it was, and
    readers of the old one are not disturbed. On stores where a rename is a copy, the pointer is a file of one line and
    is still replaced as a whole. Of two writers at once, the one that points last wins. Old versions stay until ``vacuum``.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    write_table(df, f"{table}/{name}", by, mode="errorifexists")
    fs, path = _store(spark, table)
    draft = path(f"{table}/.{name}.pointer")
    out = fs.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    option = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(draft, path(f"{table}/{POINTER}"), options)
    return f"{table}/{name}"


def _store(spark: SparkSession, folder: str):
    """(file system, function that makes a path) of the store that holds ``folder``."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def current(spark: SparkSession, table: str) -> str | None:
    """The folder of the published version, or none if nothing was published yet."""
    fs, path = _store(spark, table)
    if not fs.exists(path(f"{table}/{POINTER}")):
        return None
    stream = fs.open(path(f"{table}/{POINTER}"))
    try:
        name = bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()
    return f"{table}/{name}"


def read_published(spark: SparkSession, table: str) -> DataFrame:
    """The published version; a reader keeps it even if another is published meanwhile."""
    folder = current(spark, table)
    if folder is None:
        raise FileNotFoundError(f"nothing is published at {table}")
    return spark.read.parquet(folder)


def vacuum(spark: SparkSession, table: str) -> int:
    """Deletes all versions but the published one, those of failed writers too, and tells how many. Call it when no reader of an older one is left."""
    keep, (fs, path) = current(spark, table), _store(spark, table)
    old = [s.getPath() for s in fs.listStatus(path(table)) if s.isDirectory() and s.getPath().getName().startswith("v-") and (keep is None or s.getPath().getName() != keep.rsplit("/", 1)[-1])]
    for p in old:
        fs.delete(p, True)
    return len(old)
