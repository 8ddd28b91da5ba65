"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a pseudo-rotation, three rounds of random signs and a fast Hadamard
transform, and falls to the nearest signed axis; further, smaller cross-polytopes refine large
tables. A query probes, in several tables, the buckets whose axes lose least against its own. How many it
probes is measured: the exact neighbours of a bounded sample of the queries, among all rows, tell
the smallest number that finds the wanted share of them. Buckets and the queries that probe them
are dealt out in blocks, and candidates are ranked by exact distances of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import whole_keys, written

RESULT = "query_id long, rank int, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) times the Hadamard matrix, over its root: keeps lengths."""
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


@dataclass(frozen=True)
class CrossPolytopes:
    """Hash functions of ``tables`` tables: ``signs`` by table, level and round; ``axes`` of each level."""

    signs: np.ndarray
    axes: tuple[int, ...]

    @classmethod
    def of(cls, width: int, tables: int, buckets: float, seed: int) -> CrossPolytopes:
        """For vectors of ``width`` entries; levels are added until there are ``buckets`` buckets."""
        full = 1 << max(width - 1, 0).bit_length()
        axes, made = [full], 2 * full
        while made < buckets:
            axes.append(min(full, 1 << max(int(np.ceil(np.log2(buckets / made))) - 1, 0)))
            made *= 2 * axes[-1]
        return cls(np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, len(axes), 3, full)), tuple(axes))

    def cut(self, levels: int) -> CrossPolytopes:
        return CrossPolytopes(self.signs[:, :levels], self.axes[:levels])

    @property
    def buckets(self) -> int:
        return int(np.prod([2 * a for a in self.axes], dtype=object))

    def turned(self, x: np.ndarray, table: int, level: int) -> np.ndarray:
        """Coordinates of the unit rows along the signed axes of a level: the positive ones, then the negative."""
        full = self.signs.shape[-1]
        z = np.pad(x, ((0, 0), (0, full - x.shape[1])))
        for s in self.signs[table, level]:
            z = hadamard(z * s)
        z = z[:, : self.axes[level]]
        return np.concatenate([z, -z], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table; the first level is the leading digit."""
        out = np.zeros((len(x), len(self.signs)), dtype=np.int64)
        for t in range(len(self.signs)):
            for level, a in enumerate(self.axes):
                out[:, t] = out[:, t] * 2 * a + self.turned(x, t, level).argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """(row, table, place): each row's ``most`` buckets of least loss, nearest first. A level loses the squared difference to its largest coordinate."""
        most, out = min(most, self.buckets), []
        for t in range(len(self.signs)):
            loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
            for level, a in enumerate(self.axes):
                z = self.turned(x, t, level)
                own = np.square(z.max(axis=1, keepdims=True) - z)
                axis = np.argsort(own, axis=1, kind="stable")[:, :most]
                both = loss[:, :, None] + np.take_along_axis(own, axis, 1)[:, None, :]
                codes = code[:, :, None] * (2 * a) + axis[:, None, :]
                both, codes = both.reshape(len(x), -1), codes.reshape(len(x), -1)
                best = np.argsort(both, axis=1, kind="stable")[:, :most]
                loss, code = np.take_along_axis(both, best, 1), np.take_along_axis(codes, best, 1)
            out.append(code)
        return np.stack(out, axis=1)


def matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``x`` to the same row of ``y``."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        apart = x - y
        peak = np.abs(apart).max(axis=1)
        plain = np.sqrt(np.square(apart).sum(axis=1))
        odd = (peak > 0) & ((peak < 1e-150) | (peak > 1e150))
        if odd.any():  # squares would overflow or underflow
            half, by = x[odd] / 2 - y[odd] / 2, peak[odd] / 2
            by = np.where(np.isfinite(by), by, np.abs(half).max(axis=1))
            plain[odd] = 2 * by * np.sqrt(np.square(half / by[:, None]).sum(axis=1))
    return plain


def ranked(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``k`` nearest rows of each query by exact distance, ties to the smaller id; a row of the query's own id is left out.

    A product of matrices gives squared distances with a known error first; all rows within it are measured.
    """
    found = []
    scale = max(np.abs(queries).max(), np.abs(rows).max())
    y = rows / scale
    long = np.square(y).sum(axis=1)
    for s in range(0, len(queries), 256):
        x = queries[s : s + 256] / scale
        square = np.square(x).sum(axis=1)
        rough = square[:, None] + long - 2 * (x @ y.T)
        rough[query_ids[s : s + 256, None] == ids] = np.inf
        limit = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        error = 1e-14 * x.shape[1] * (square + long.max())
        i, j = np.nonzero((rough <= (limit + error)[:, None]) & np.isfinite(rough))
        if not len(i):
            continue
        far = np.concatenate([distances(queries[s + i[a : a + 65536]], rows[j[a : a + 65536]]) for a in range(0, len(i), 65536)])
        order = np.lexsort((ids[j], far, i))
        i, j, far = i[order], j[order], far[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((s + i[place < k], j[place < k], far[place < k]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def folded(rows: DataFrame, k: int) -> DataFrame:
    """Of each group of equal vectors the ``k`` + 1 rows of smallest id: no other can be among the ``k`` nearest of any query. Rows equal in both count once."""
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    kept = rows.withColumn("h", F.xxhash64("v")).withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1)
    return kept.dropDuplicates(["h", "v", "vec_id"]).select("vec_id", "v")


def calibrated(index: DataFrame, sample: pd.DataFrame, hashes: CrossPolytopes, *, k: int, recall: float, most: int) -> tuple[CrossPolytopes, int, float]:
    """(hashes, probes, recall): of the levels of ``hashes``, those and the number of probes that look at the least share of the index and still find ``recall`` of the sample's exact neighbours.

    All rows are compared with the sample, each task keeping ``k`` a query. One level with all its buckets probed finds everything.
    """
    ids, x = sample["vec_id"].to_numpy(), matrix(sample["v"])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = matrix(batch["v"])
            q, j, far = ranked(ids, x, batch["vec_id"].to_numpy(), rows, k)
            if len(q):
                yield pd.DataFrame({"q": q, "vec_id": batch["vec_id"].to_numpy()[j], "far": far, "codes": list(hashes.codes(units(rows[j])))})

    best = Window.partitionBy("q").orderBy("far", "vec_id")
    truth = index.mapInPandas(nearest, "q int, vec_id long, far double, codes array<long>").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).toPandas()
    if not len(truth):
        return hashes.cut(1), hashes.cut(1).buckets, 1.0
    codes, q = np.stack(truth["codes"].to_numpy()), truth["q"].to_numpy()
    choice = None
    for levels in range(1, len(hashes.axes) + 1):
        h = hashes.cut(levels)
        own = codes // int(np.prod([2 * a for a in hashes.axes[levels:]], dtype=np.int64))
        order = h.probes(units(x), most)
        place = np.full(len(own), order.shape[2])
        for s in range(0, len(own), 1024):
            same = order[q[s : s + 1024]] == own[s : s + 1024, :, None]
            place[s : s + 1024] = np.where(same.any(axis=2), same.argmax(axis=2), order.shape[2]).min(axis=1)
        enough = np.sort(place)[max(int(np.ceil(recall * len(place))) - 1, 0)] + 1
        if enough <= order.shape[2] and (choice is None or enough / h.buckets < choice[1] / choice[0].buckets):
            choice = (h, int(enough), float((place < enough).mean()))
    return choice


def _sized(left: DataFrame, sizes: DataFrame, most: int, count: int) -> DataFrame:
    """``left`` joined with ``sizes`` on ``key``: by broadcast up to ``most`` rows of it, else by a join in which a key is salted."""
    if count <= most:
        return left.join(F.broadcast(sizes), "key")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return left.withColumn("salt", F.pmod(F.hash("vec_id"), F.lit(64))).join(salted, ["key", "salt"]).drop("salt")


def compared(index: DataFrame, queries: DataFrame, *, k: int, block: int, broadcast_rows: int) -> DataFrame:
    """(q, query_id, vec_id, score): for each query and block of rows that share a ``key``, the ``k`` nearest.

    A key's rows and queries are dealt out by blocks of about ``block`` rows and four times as many queries, so that no task
    holds a key; rows of keys without a query, and queries of keys without rows, go no further.
    """
    n, m = index.groupBy("key").agg(F.count("*").alias("n")), queries.groupBy("key").agg(F.count("*").alias("m"))
    sizes = n.join(m, "key").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / (4 * block)).cast("int").alias("lots"))
    sizes = written(sizes, "sizes")
    count = sizes.count()
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = _sized(index, sizes, broadcast_rows, count).withColumn("block", F.pmod(F.hash("vec_id", F.lit(1)), "blocks")).withColumn("lot", every("lots"))
    asked = _sized(queries, sizes, broadcast_rows, count).withColumn("lot", F.pmod(F.hash("vec_id", F.lit(2)), "lots")).withColumn("block", every("blocks"))
    unit = F.xxhash64("key", "block", "lot").alias("unit")
    both = rows.select(unit, F.lit(None).cast("long").alias("q"), "vec_id", "v").unionByName(asked.select(unit, "q", "vec_id", "v"))
    both = both.select("unit", F.col("q").isNotNull().alias("asks"), F.coalesce("q", F.lit(0)).alias("q"), "vec_id", "v")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends in whole_keys(batches, "unit"):
            asks, q, ids, made = frame["asks"].to_numpy(), frame["q"].to_numpy(), frame["vec_id"].to_numpy(), []
            for s, e in zip(starts, ends):
                half = s + int(np.searchsorted(asks[s:e], True))
                if s < half < e:
                    i, j, far = ranked(ids[half:e], matrix(frame["v"].iloc[half:e]), ids[s:half], matrix(frame["v"].iloc[s:half]), k)
                    made.append(pd.DataFrame({"q": q[half + i], "query_id": ids[half + i], "vec_id": ids[s + j], "score": far}))
            if made:
                yield pd.concat(made, ignore_index=True)

    return both.repartition("unit").sortWithinPartitions("unit", "asks", "vec_id").mapInPandas(search, "q long, query_id long, vec_id long, score double")


def _of_one_length(rows: DataFrame, width: int, *, k: int, every: int, tables: int, recall: float, sample: int, bucket_rows: int, probes: int, broadcast_rows: int, seed: int) -> DataFrame | None:
    index = written(folded(rows, k), "index")
    queries = written(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.xxhash64("vec_id", "v").alias("q")).dropDuplicates(["q", "vec_id"]), "queries")
    taken = queries.orderBy("q").limit(sample).select("vec_id", "v").toPandas()
    n = index.count()
    if not len(taken) or n < 2:
        return None
    hashes = CrossPolytopes.of(width, tables, n / bucket_rows, seed)
    hashes, each, _ = calibrated(index, taken, hashes, k=k, recall=recall, most=probes)
    buckets = hashes.buckets

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        return pd.Series(list(hashes.codes(units(matrix(v))) + np.arange(tables) * buckets))

    @F.pandas_udf("array<long>")
    def probed(v: pd.Series) -> pd.Series:
        x, out = units(matrix(v)), []
        for s in range(0, len(x), 256):
            out += list((hashes.probes(x[s : s + 256], each) + np.arange(tables)[:, None] * buckets).reshape(len(x[s : s + 256]), -1))
        return pd.Series(out)

    block = int(np.clip(n * tables / 512, 256, 4096))
    keyed = written(index.select("vec_id", "v", keys("v").alias("keys")), "keys").select("vec_id", "v", F.explode("keys").alias("key"))
    asked = written(queries.select("q", "vec_id", "v", probed("v").alias("keys")), "probes").select("q", "vec_id", "v", F.explode("keys").alias("key"))
    found = written(compared(keyed, asked, k=k, block=block, broadcast_rows=broadcast_rows).distinct(), "found")
    short = queries.join(found.groupBy("q").agg(F.count("*").alias("n")), "q", "left").where(F.coalesce("n", F.lit(0)) < min(k, n - 1))
    short = written(short.select("q", "vec_id", "v"), "short")
    if short.isEmpty():
        return found
    parts = -(-n // block)  # all rows are compared with queries that found too few
    keyed = index.withColumn("key", F.pmod(F.hash("vec_id"), F.lit(parts)).cast("long"))
    asked = short.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    return found.unionByName(compared(keyed, asked, k=k, block=2 * block, broadcast_rows=broadcast_rows)).distinct()


def nearest_neighbours(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    every: int = 100,
    tables: int = 4,
    recall: float = 0.96,
    sample: int = 256,
    bucket_rows: int = 512,
    probes: int = 1024,
    broadcast_rows: int = 1_000_000,
    seed: int = 13,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest rows found of each row whose id ``every`` divides, by Euclidean distance.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
    take no part. Only vectors of one length are compared. Rows that repeat both id and vector count
    once; rows of a query's own id are its own, and two vectors of one query id are two queries.
    Every row is indexed. The number of probes is the smallest that finds ``recall`` of the exact
    neighbours of the ``sample`` queries of smallest hash; a query that finds fewer than ``k`` rows is
    compared with all. ``bucket_rows`` sets the number of buckets; ``probes`` bounds those tried before
    fewer levels are. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0))
    rows = rows.withColumn("v", F.transform(v, lambda e: e + F.lit(0).cast(kind[6:-1])))  # -0.0 is 0.0
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    options = dict(k=k, every=every, tables=tables, recall=recall, sample=sample, bucket_rows=bucket_rows, probes=probes, broadcast_rows=broadcast_rows, seed=seed)
    found = [f for d in lengths if (f := _of_one_length(rows.where(F.size("v") == d), d, **options)) is not None]
    if not found:
        return spark.createDataFrame([], RESULT)
    out = reduce(DataFrame.unionByName, found)
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
