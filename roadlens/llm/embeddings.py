"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal directions is learned so that signs lose least (iterative quantisation);
the signs are a vector's code. Its chunks, as wide as the number of vectors asks for, are the keys of one table each. In every
table a vector stands in its own bucket and in those at Hamming distance 1 that its least certain
bits lead to, so that chunks which differ by up to two such bits still meet.

Codes go through the tables first: in a bucket they are compared by Hamming distance, and only vectors with a partner within
reach go on. These are reranked with the cosine of the original vectors in double
precision. A pair that meets in several buckets counts in one of them only, which both codes
tell, so no list of pairs is ever made: a task returns counts and a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import roots_of, whole_keys, written
from roadlens.llm.components import components


def fit_rotation(x: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation over the unit rows ``x``; more ``bits`` than dimensions come from further rotations.

    A row weighs one over the number of rows about it (cosine 0.98), so that a group of near copies
    counts once. The mean is drawn towards the origin by one over the weight of all, or else the
    codes of one tight group would tell its noise only.
    """
    weight = np.concatenate([1 / np.maximum((x[i : i + 512] @ x.T >= 0.98).sum(axis=1), 1) for i in range(0, len(x), 512)])
    mean = np.average(x, axis=0, weights=weight) * (1 - 1 / max(weight.sum(), 1))
    x = x * np.sqrt(weight)[:, None]
    centred = x - np.sqrt(weight)[:, None] * mean
    most = min(bits, x.shape[1])
    directions = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :most]
    v = centred @ directions
    made, rng = [], np.random.default_rng(seed)
    for _ in range(0, bits, most):
        rotation = np.linalg.qr(rng.standard_normal((most, most)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        made.append(directions @ rotation)
    return mean, np.concatenate(made, axis=1)[:, :bits]


class Codes:
    """Codes of unit vectors in ``tables`` chunks of ``width`` bits, packed into 64-bit words without cutting a chunk."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray, tables: int, width: int, probes: int):
        self.mean, self.projection, self.tables, self.width, self.probes = mean, projection, tables, width, min(probes, width)
        self.per = 64 // width

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, own chunks, chunks probed), all uint64; rows of another dimension are cut or filled with zeros for it.

        What is probed are the chunks with one bit flipped, for the bits nearest to their threshold: table by table for the first, then for the next.
        """
        d = len(self.mean)
        x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
        y = ((x - self.mean) @ self.projection).reshape(len(x), self.tables, self.width)
        place = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        own = ((y >= 0) * place).sum(axis=2, dtype=np.uint64)
        least = np.argsort(np.abs(y), axis=2, kind="stable")[:, :, : self.probes]
        near = np.concatenate([own ^ place[least[:, :, i]] for i in range(self.probes)], axis=1)
        words = np.zeros((len(x), -(-self.tables // self.per)), dtype=np.uint64)
        for t in range(self.tables):
            words[:, t // self.per] |= own[:, t] << np.uint64(t % self.per * self.width)
        return words, own, near

    def compare(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Hamming distance, first table whose chunks are equal or -1) of words that are broadcast against each other."""
        apart = [a[..., i] ^ b[..., i] for i in range(a.shape[-1])]
        distance = sum(np.bitwise_count(w).astype(np.int16) for w in apart)
        first = np.full(distance.shape, -1, dtype=np.int8)
        for t in reversed(range(self.tables)):
            mask = np.uint64(((1 << self.width) - 1) << (t % self.per * self.width))
            first[(apart[t // self.per] & mask) == 0] = t
        return distance, first

    def reach(self, x: np.ndarray, threshold: float, seed: int = 11) -> int:
        """Largest Hamming distance between ``x`` and rows made at exactly the ``threshold``, and one bit in 32 over."""
        side = np.random.default_rng(seed).standard_normal(x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((side * side).sum(axis=1, keepdims=True))
        other = threshold * x + np.sqrt(1 - threshold * threshold) * side / np.where(size > 0, size, 1)
        distance, _ = self.compare(self.encode(x)[0], self.encode(other)[0])
        return int(distance.max(initial=0)) + self.tables * self.width // 32 + 1


def _units(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    peak = np.abs(x).max(axis=1, keepdims=True)
    x = x / peak  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _counts_here(own: np.ndarray, probed: np.ndarray, i: np.ndarray, j: np.ndarray, node: int) -> np.ndarray:
    """Whether pairs i-j count in the bucket ``node``: in that of their first equal chunk, or, where none is equal, in the smallest that both stand in."""
    equal = own[i] == own[j]
    some = equal.any(axis=1)
    out = some & (own[i, equal.argmax(axis=1)] == node)
    rest = np.flatnonzero(~some)
    if len(rest):
        a, b = (np.concatenate([own[k[rest]], probed[k[rest]]], axis=1) for k in (i, j))
        both = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[rest] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == node
    return out


def embedding_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int = 6,
    probes: int = 2,
    sample: int = 8192,
    block: int = 1024,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels are equal and not null, they have one length, and their cosine is
    at least ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are kept. Equal vectors of a label are folded into one class first, known
    by a 64-bit hash; rows that repeat an id keep a row each; a null id never names a component
    unless all of it has none. Ids have to be whole numbers, or texts of such. Other columns are ignored. The rotation is fitted on the ``sample``
    vectors of smallest hash, and the Hamming distance within reach is measured on them; every vector is indexed. A chunk has as many bits as
    a number of the classes (8 to 32), so that buckets stay as small however many there are. A bucket of over ``block`` vectors is dealt
    out as pairs of blocks, so that none lands in one task; the buckets of that size are broadcast up to
    ``broadcast_rows`` (12 bytes each) and joined by a salted shuffle beyond.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & usable, F.lit(False)))
    rows = rows.withColumn("c", F.when(F.col("ok"), F.xxhash64("label", F.transform(v, lambda x: x + 0.0))))  # -0.0 is 0.0
    good = rows.where("ok")
    classes = written(
        good.groupBy("c").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v")), "classes"
    )
    n = classes.count()
    width = min(max(int(n).bit_length(), 8), 32)
    if n:
        dim = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()["d"]
        taken = _units(classes.where(F.size("v") == dim).orderBy("c").limit(sample).select("v").toPandas()["v"])
        codes = Codes(*fit_rotation(taken, tables * width), tables, width, probes)
        limit = codes.reach(taken, threshold)
    else:
        codes, limit = Codes(np.zeros(1), np.ones((1, tables * width)), tables, width, probes), 0
    model = spark.sparkContext.broadcast(codes)

    @F.pandas_udf("words array<long>, own array<long>, near array<long>")
    def code(s: pd.Series) -> pd.DataFrame:
        out, sizes = [None] * len(s), s.map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            parts = [p.view(np.int64) for p in model.value.encode(_units(s.iloc[at]))]
            for i, row in zip(at, zip(*parts)):
                out[i] = row
        return pd.DataFrame(out, columns=["words", "own", "near"])

    coded = classes.select("c", "copies", F.hash("label").alias("l"), F.size("v").alias("d"), code("v").alias("k"), "v")
    node = lambda cells: F.transform(cells, lambda x, i: F.xxhash64("l", "d", F.pmod(i, F.lit(tables)), x))
    coded = written(coded.select("c", "copies", "k.words", node("k.own").alias("own"), node("k.near").alias("near"), "v"), "codes")
    key = lambda mine: lambda x, i: F.struct(x.alias("node"), F.pmod(i, F.lit(tables)).alias("t"), F.lit(mine).alias("mine"))
    keys = (F.transform("own", key(True)), F.transform("near", key(False)))
    narrow = coded.select("c", "words", F.explode(F.concat(*keys)).alias("k")).select("c", "words", "k.*")

    def dealt(rows: DataFrame) -> DataFrame:
        """``rows`` of buckets (c, node) with ``unit``, a bucket or a pair of its blocks, ``side``, the row's block, and ``cross``, whether the blocks are two."""
        hot = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > block)
        hot = written(hot.select(F.col("node").alias("hot"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
        if hot.count() <= broadcast_rows:  # one row for each ``block`` of all rows at most
            placed = rows.join(F.broadcast(hot), F.col("node") == F.col("hot"), "left").drop("hot")
        else:
            salt = F.explode(F.sequence(F.lit(0), F.lit(63)))
            placed = rows.withColumn("salt", F.pmod(F.hash("c"), F.lit(64))).join(hot.select("*", salt.alias("salt_")), (F.col("node") == F.col("hot")) & (F.col("salt") == F.col("salt_")), "left").drop("salt", "salt_", "hot")
        placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod(F.hash("c"), F.col("blocks")))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return placed.withColumns({"unit": F.xxhash64("node", F.least("side", "other"), F.greatest("side", "other")), "cross": F.col("side") != F.col("other")}).drop("other")

    def in_units(df: DataFrame) -> DataFrame:
        return df.repartition("unit").sortWithinPartitions("unit", "side", "c")

    def pairs(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Start, end, left and right rows of each unit that has both."""
        side, cross = frame["side"].to_numpy(), frame["cross"].to_numpy()
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            half = s + int(np.searchsorted(side[s:e], side[e - 1])) if cross[s] else s
            if half > s:
                yield s, e, np.arange(s, half), np.arange(half, e)
            elif not cross[s]:
                yield s, e, np.arange(s, e), np.arange(s, e)

    def within_reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = model.value
        for frame, starts, ends in whole_keys(batches, "unit"):
            words, mine, t = np.stack(frame["words"].to_numpy()).view(np.uint64), frame["mine"].to_numpy(), frame["t"].to_numpy()
            alive = np.zeros(len(frame), dtype=bool)
            for s, _, left, right in pairs(frame, starts, ends):
                distance, first = codes.compare(words[left][:, None], words[right][None])
                # a pair with equal chunks counts in the first of these; one without goes on from wherever it meets
                near = (distance <= limit) & ((first < 0) | ((first == t[s]) & mine[left][:, None] & mine[right][None]))
                if left is right or left[0] == right[0]:
                    np.fill_diagonal(near, False)
                alive[left] |= near.any(axis=1)
                alive[right] |= near.any(axis=0)
            if alive.any():
                yield frame.loc[alive, ["c", "node"]]

    alive = written(in_units(dealt(narrow)).mapInPandas(within_reach, "c long, node long").distinct(), "alive")
    going = in_units(dealt(alive).join(coded.drop("words"), "c"))

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends in whole_keys(batches, "unit"):
            c, copies, node = frame["c"].to_numpy(), frame["copies"].to_numpy(), frame["node"].to_numpy()
            own, probed = np.stack(frame["own"].to_numpy()), np.stack(frame["near"].to_numpy())
            made = []
            for s, e, left, right in pairs(frame, starts, ends):
                x = _units(frame["v"].iloc[left])
                same = left[0] == right[0]
                near = x @ (x if same else _units(frame["v"].iloc[right])).T >= threshold
                if same:
                    near = np.triu(near, 1)
                i, j = (p[q] for p, q in zip((left, right), np.nonzero(near)))
                here = np.concatenate([_counts_here(own, probed, i[at : at + 8192], j[at : at + 8192], node[s]) for at in range(0, len(i), 8192)] or [np.zeros(0, dtype=bool)])
                i, j = i[here], j[here]
                if not len(i):
                    continue
                links = np.zeros(e - s, dtype=np.int64)
                np.add.at(links, i - s, copies[j])
                np.add.at(links, j - s, copies[i])
                root = roots_of(e - s, i - s, j - s)
                has = np.flatnonzero(links)
                made.append(pd.DataFrame({"a": c[s + has], "b": c[s + root[has]], "n": links[has]}))
            if made:
                yield pd.concat(made, ignore_index=True)

    found = written(going.mapInPandas(rerank, "a long, b long, n long"), "links")
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    linked = classes.select("c", "copies", "least").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(least, "root").join(links, "c", "left")
    known = known.select("c", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "c").join(known, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
