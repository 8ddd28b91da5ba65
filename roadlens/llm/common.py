"""Helpers that several corpus operators share."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-roadlens-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bytes_of(df: DataFrame, *columns: str) -> int:
    """Bytes of the text of ``columns`` over all of ``df``: what a broadcast of it would hold, besides some 50 bytes a row."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns), F.lit(50).cast("long"))
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Binds ``value`` once, so that a lambda over it does not compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is faster and equal where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Of batches sorted by ``key``: frames in which no key is cut off, with the start and end of each key's rows.

    Holds one batch and the rows of one key, so the rows of a key must be bounded.
    """
    held: list[pd.DataFrame] = []

    def told(frame: pd.DataFrame):
        k = frame[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        return frame, starts, np.r_[starts[1:], len(k)]

    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        if held and held[-1][key].iloc[-1] != k[0]:
            yield told(pd.concat(held, ignore_index=True))
            held = []
        other = np.flatnonzero(k != k[-1])
        if len(other):
            cut = other[-1] + 1
            yield told(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
            held, batch = [], batch.iloc[cut:]
        held.append(batch)
    if held:
        yield told(pd.concat(held, ignore_index=True))


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes can reach through the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
