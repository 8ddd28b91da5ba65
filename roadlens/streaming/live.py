"""Structured Streaming forms of resampling, segmentation and history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadlens.sources.scratch import scratch


def read_feed(spark: SparkSession, folder: str, schema: StructType, glob: str = "*", files: int = 1000) -> DataFrame:
    """The Parquet files of a folder as they arrive, oldest first, ``files`` at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def stream_resample(feed: DataFrame, delay: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """(trip_id, window, value, samples) of a live feed (trip_id, ts, event_id, value): the last value that is not null in each bin.

    Rows that repeat an event are dropped within the delay; rows later than it are left out. State is bounded by the watermark.
    """
    f = feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("ts", "event_id")))
    return f.groupBy("trip_id", F.window("ts", width).alias("bin")).agg(last.alias("value"), F.count("*").alias("samples"))


def stream_segments(feed: DataFrame, gap: str = "3 seconds", delay: str = "10 seconds") -> DataFrame:
    """(trip_id, segment, samples, first, last): sessions that a gap of inactivity ends; one of exactly the gap goes on."""
    s = feed.withWatermark("ts", delay).groupBy("trip_id", F.session_window("ts", gap).alias("segment"))
    return s.agg(F.count("*").alias("samples"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def foreach_append(path: str):
    """For ``foreachBatch``: appends the rows whose (trip_id, window_id) the history at ``path`` does not hold yet; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["trip_id", "window_id"])
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            new = new.join(spark.read.parquet(path).select("trip_id", "window_id"), ["trip_id", "window_id"], "left_anti")
        new.write.mode("append").parquet(path)

    return write


def run_now(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of all that the feed holds now, as a table in the shared folder."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "stream")
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def run_arrivals(arrivals: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` of a feed has given out, in append mode, after ``arrivals`` have come in one after the other.

    Each arrival is written to the feed's folder and worked off by a query that starts anew from the progress and the state of the
    last one, as after a restart. A window is given out once the watermark has passed its end, and leaves the state then; rows
    behind the watermark are dropped. What is still open at the end is not in the result.
    """
    spark = arrivals[0].sparkSession
    folder, out, progress = (scratch(spark, n) for n in ("feed", "stream", "progress"))
    write = lambda df, _: df.write.mode("append").parquet(out)
    for rows in arrivals:
        rows.write.mode("append").parquet(folder)
        q = make(read_feed(spark, folder, arrivals[0].schema, "*.parquet")).writeStream.outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    return spark.read.parquet(out)
