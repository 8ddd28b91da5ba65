"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, and the distinct ones are the rows of a matrix, centred before anything is multiplied. It
lies in blocks of rows in the shared folder. Each step multiplies it with a right vector (Xv) and its transpose with the
left vector that comes of it (Xᵀu); both products are one pass over the blocks each, summed by Spark, and the driver sees
sums of the vectors' dimension only. Left vectors are never stored: each is X g for a known g. Both sides are
orthogonalised against all earlier vectors. Singular values and vectors of the small bidiagonal matrix give deviations
and components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import written

OFFSET = 1_000_000
MOST = 9.2e18  # entries beyond are drawn to it, so that adding OFFSET stays within a long


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): each vector as longs floor(64 c) + 1,000,000; null vectors and those with null or non-finite entries are left out."""
    c = F.col(vec_col).cast("array<double>")
    usable = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.least(e * 64, F.lit(MOST)), F.lit(-MOST))) + F.lit(OFFSET).cast("long"))
    return vectors.where(usable & (F.size(vec_col) > 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _exact(x: np.ndarray) -> np.ndarray:
    """``x`` as it is if sums and products of it fit a long, else as Python's whole numbers."""
    return x if not x.size or np.abs(x.astype(float)).max() * len(x) < 2**62 else x.astype(object)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, exact sums of each dimension)."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0
        for batch in batches:
            x = _exact(np.stack(batch["x"].to_numpy()))
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pd.DataFrame({"pos": range(-1, len(total)), "part": [str(v) for v in (n, *total)]})

    parts = fit.select("x").mapInPandas(add, "pos int, part string")
    got = parts.groupBy("pos").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    return (int(got[0]["s"]), [int(r["s"]) for r in got[1:]]) if got else (0, [])


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S/n in double precision: the whole part of the mean is taken off exactly first."""
    whole = [s // n for s in total]
    rest = np.array([(s - w * n) / n for s, w in zip(total, whole)])
    if max(map(abs, whole), default=0) < 2**61 and (not x.size or np.abs(x.astype(float)).max() < 2**61):
        return (x - np.array(whole, dtype=np.int64)).astype(float) - rest
    return (x.astype(object) - np.array(whole, dtype=object)).astype(float) - rest


def blocks_of(fit: DataFrame, n: int, total: list[int], rows: int = 4096) -> DataFrame:
    """(block): the centred rows as blocks of at most ``rows`` rows of doubles."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), rows):
                yield pd.DataFrame({"block": [centred(np.stack(batch["x"].iloc[i : i + rows].to_numpy()), n, total).tobytes()]})

    return written(fit.select("x").mapInPandas(pack, "block binary"), "centred")


def summed(blocks: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of the vector ``of(block)``: one row a task and position is made, added up before and after the shuffle."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for raw in batch["block"]:
                got = of(np.frombuffer(raw).reshape(-1, dim))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"pos": np.arange(len(total), dtype=np.int32), "part": total})

    parts = blocks.mapInPandas(add, "pos int, part double").groupBy("pos").agg(F.sum("part").alias("s")).collect()
    return np.array([r["s"] for r in sorted(parts, key=lambda r: r["pos"])])


def bidiagonalised(blocks: DataFrame, n: int, dim: int, *, scale: float, steps: int | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B: orthonormal columns of V, upper bidiagonal B.

    Runs ``steps`` steps, as many as the matrix has dimensions unless given. Where a product vanishes
    (below 1e-12 of ``scale``, the matrix's norm) the directions so far are closed under X, and the
    next step starts from a random direction orthogonal to them. What all directions together leave
    is zero to double precision.
    """
    rng, k = np.random.default_rng(seed), min(steps or dim, dim)
    v, g = np.zeros((dim, 0)), np.zeros((dim, 0))
    b, beta = np.zeros((k, k)), 0.0

    def orthogonal(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - v @ (v.T @ w)
        return w

    def fresh() -> np.ndarray:
        w = orthogonal(rng.standard_normal(dim))
        return w / np.linalg.norm(w)

    new = fresh()
    for j in range(k):
        v = np.column_stack([v, new])
        q = new - (beta * g[:, -1] if j and beta else 0)  # X q = X v - beta u
        for _ in range(2):  # the second round tells the norm of what is left, to full precision

            def inner(x: np.ndarray, q=q) -> np.ndarray:
                p = x @ q
                return np.r_[(x @ g).T @ p, p @ p]

            *c, square = summed(blocks, dim, inner)
            if np.linalg.norm(c) <= 1e-14 * np.sqrt(square):
                break
            q = q - g @ np.array(c)
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= 1e-12 * scale:
            g, beta, w = np.column_stack([g, np.zeros(dim)]), 0.0, None
        else:
            b[j, j] = alpha
            g = np.column_stack([g, q / alpha])
            w = orthogonal(summed(blocks, dim, lambda x, u=q / alpha: x.T @ (x @ u)) - alpha * new)
            beta = float(np.linalg.norm(w))
        if j + 1 == k:
            break
        if w is None or beta <= 1e-12 * scale:
            beta, new = 0.0, fresh()
        else:
            new, b[j, j + 1] = w / beta, beta
    return v, b


def whitened_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, steps: int | None = None, seed: int = 11
) -> DataFrame:
    """Per row and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Left out are rows whose vector is null, empty or holds null or non-finite entries, and vectors of
    another length than the commonest (ties: the shorter), which lie in another space. Entries of
    which 64 times is beyond 9.2e18 are drawn to that. Repeated rows and ids have rows of their own,
    but equal vectors count once in the fit. Directions without variance have no component, so a
    single vector, or equal ones, give no rows. A deviation that no long holds is null. Other
    columns are ignored. ``steps`` bounds the bidiagonalisation (all dimensions unless given);
    components of a bounded one are approximate.
    """
    spark = vectors.sparkSession
    rows = written(whole_numbers(vectors, id_col, vec_col), "rows")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = schema.replace("vec_id long", f"vec_id {vectors.schema[id_col].dataType.simpleString()}")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["d"]
    rows = rows.where(F.size("x") == dim)
    fit = written(rows.select("x").distinct(), "fit")
    n, total = sums(fit)
    blocks = blocks_of(fit, n, total)
    peak = summed(blocks, dim, lambda x: np.r_[(x * x).sum()])[0]  # n times the trace of the covariance
    if not peak > 0:
        return spark.createDataFrame([], schema)
    v, b = bidiagonalised(blocks, n, dim, scale=np.sqrt(peak), steps=steps, seed=seed)
    _, sigma, right = np.linalg.svd(b)
    kept = int((sigma[:components] > 1e-11 * np.sqrt(peak)).sum())
    weights = (v @ right.T)[:, :kept] / (sigma[:kept] / np.sqrt(n))  # unit directions over deviations
    explained = sigma[:kept] ** 2 / peak

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ weights
        return np.r_[w.sum(axis=0), (w.T @ w).ravel()]

    got = summed(blocks, dim, moments) / n
    covariance = got[kept:].reshape(kept, kept) - np.outer(got[:kept], got[:kept])
    error = float(np.abs(covariance - np.eye(kept)).max())

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                ids, x = batch["vec_id"].iloc[i : i + 1024], np.stack(batch["x"].iloc[i : i + 1024].to_numpy())
                far = centred(x, n, total)
                if np.square(far * n).sum(axis=1).max() < 2**61 and np.abs(x.astype(float)).max() * n < 2**61 and max(map(abs, total)) < 2**61:
                    deviation = np.square(x * n - np.array(total, dtype=np.int64)).sum(axis=1).astype(object)
                else:
                    deviation = np.square(x.astype(object) * n - np.array(total, dtype=object)).sum(axis=1)
                deviation = [int(y) if y < 2**63 else None for y in deviation]
                yield pd.DataFrame(
                    {
                        "vec_id": np.repeat(ids.to_numpy(), kept),
                        "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x)),
                        "n": n,
                        "deviation": pd.Series(deviation, dtype="Int64").repeat(kept).to_numpy() if None not in deviation else pd.array(np.repeat(np.array(deviation, dtype=object), kept), dtype="Int64"),
                        "whitened": (far @ weights).ravel(),
                        "explained": np.tile(explained, len(x)),
                        "identity_error": error,
                    }
                )

    return rows.mapInPandas(project, schema)
