"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import written

#: Topics told from the text itself, first match first; the corpus has no topic column.
TOPICS = (
    ("licence", r"(?i)\blicen[sc]e\b"),
    ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9]{1,3} "),
    ("technical", r"[{};=<>]|::|https?://"),
    ("noisy", r"[*%$&#]{2,}|!!"),
)


def topic(text: Column) -> Column:
    """The first of ``TOPICS`` whose pattern the whole text holds; ``prose`` for any other text, null and empty ones too."""
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("prose"))


def token_count(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def rake(cells: pd.DataFrame, targets: dict[str, dict], rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of ``cells``, from column ``tokens``, whose sums over each column of ``targets`` are near its shares. Sums to 1."""
    w = cells["tokens"].to_numpy(dtype=float)
    w = w / w.sum()
    margins = []
    for c, shares in targets.items():
        code, names = pd.factorize(cells[c])
        goal = np.array([shares.get(x, 0.0) for x in names])
        margins.append((code, goal / goal.sum()))
    for _ in range(rounds):
        off = 0.0
        for code, goal in margins:
            have = np.bincount(code, weights=w, minlength=len(goal))
            off = max(off, float(np.abs(have - goal).max()))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code]
        if off < tolerance:
            break
    return w / w.sum()


def rates(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Sampling rate of each cell: in proportion to weight over tokens, at most 1, so that ``budget`` tokens are expected."""
    need = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    if need.max(initial=0) == 0 or budget >= tokens[need > 0].sum():
        return (need > 0).astype(float)
    order = np.argsort(-need, kind="stable")
    full, rest = np.cumsum(tokens[order]), np.cumsum(weights[order][::-1])[::-1]
    before = np.r_[0.0, full[:-1]]
    factor = (budget - before) / np.maximum(rest, 1e-300)
    at = int(np.argmax(factor * need[order] <= 1 + 1e-12))  # cells before it are taken whole
    return np.minimum(1.0, factor[at] * need)


def _raked_in_spark(cells: DataFrame, keys: list[str], targets: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """As ``rake``, for a table of cells too large to collect: the same rounds, stop and norming."""

    def normed(t: DataFrame) -> DataFrame:
        return written(t.crossJoin(t.agg(F.sum("w").alias("_all"))).withColumn("w", F.col("w") / F.col("_all")).drop("_all"), "cells")

    w = normed(cells.withColumn("w", F.col("tokens").cast("double")))
    for _ in range(rounds):
        off = 0.0
        for c in keys:
            have = w.groupBy(c).agg(F.sum("w").alias("have")).join(targets[c], c, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
            have = written(have, "margin")
            off = max(off, have.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0)
            factor = have.select(F.col(c).alias("_k"), F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("f"))
            w = w.join(factor, F.col(c) == F.col("_k")).withColumn("w", F.col("w") * F.col("f")).drop("_k", "f")
        w = written(w, "cells")
        if off < tolerance:
            break
    return normed(w)


def _shares(own: DataFrame, key: str, given: dict | None) -> DataFrame:
    """(key, goal), summing to 1: ``own`` (key, goal) normed; named values share what the others leave, in proportion to ``given``."""
    named = F.lit(None).cast("double")
    if given:
        named = F.create_map(*[F.lit(x) for k, v in given.items() for x in ("\x00" if k is None else k, float(v))])[F.col(key)]
    g = own.select(key, F.col("goal").alias("own"), named.alias("named"))
    sums = g.agg(F.sum("own").alias("all"), F.coalesce(F.sum(F.when(F.col("named").isNull(), F.col("own"))), F.lit(0.0)).alias("rest"), F.sum("named").alias("given"))
    scaled = F.when(F.col("given") > 0, F.col("named") / F.col("given") * (1 - F.col("rest") / F.col("all"))).otherwise(0.0)
    return g.crossJoin(sums).select(key, F.when(F.col("named").isNull(), F.col("own") / F.col("all")).otherwise(scaled).alias("goal"))


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keys: dict[str, Column] | None = None,
    targets: dict[str, dict] | None = None,
    smoothing: float = 0.7,
    budget_share: float = 0.5,
    seed: str = "mix",
    collect_rows: int = 100_000,
    rounds: int = 100,
    tolerance: float = 1e-9,
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``weight`` (of the document's tokens in the mixture), ``probability`` and ``kept``, in the place of columns of these names.

    ``keys`` are the marginals: by default source, language and the topic told from the text. Shares
    that ``targets`` does not give are the corpus's own, raised to ``smoothing`` and normed; also those of
    single values that it does not name, for which the named shares are scaled down. Null values of a key
    are a value of their own, named None; null and empty texts have no tokens, no weight and are not kept.
    ``budget_share`` of all tokens are expected in the sample. Whether a row is kept follows from the
    MD5 of its id (a null one: of its text) and ``seed``; rows that repeat an id are kept or left together.
    Cells are pre-aggregated sums. Up to ``collect_rows`` of them are raked in numpy on the driver; more
    are raked by joins. Both go on until no margin is off by ``tolerance``, ``rounds`` times at most.
    """
    keys = keys or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col(text_col))}
    names = [f"_{k}" for k in keys]
    made = {f"_{k}": F.coalesce(c.cast("string"), F.lit("\x00")) for k, c in keys.items()} | {"_n": token_count(F.col(text_col)), "_text": F.col(text_col), "_id": F.col(id_col).cast("string")}
    d = docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(n) for n, c in made.items()])
    cells = written(d.groupBy(*names).agg(F.sum("_n").alias("tokens")).where("tokens > 0"), "mixture")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for k in keys:
        own = cells.groupBy(f"_{k}").agg(F.sum("tokens").alias("t"))
        own = own.select(f"_{k}", F.pow(F.col("t") / F.lit(float(max(total, 1))), smoothing).alias("goal"))
        goals[f"_{k}"] = _shares(own, f"_{k}", (targets or {}).get(k))
    if cells.count() <= collect_rows:
        frame = cells.orderBy(*names).toPandas()
        shares = {n: dict(goals[n].toPandas().itertuples(index=False, name=None)) for n in names}
        w = rake(frame, shares, rounds, tolerance) if len(frame) else np.empty(0)
        frame["w"], frame["rate"] = w, rates(frame["tokens"].to_numpy(dtype=float), w, budget_share * total)
        rated = docs.sparkSession.createDataFrame(frame.astype({"tokens": "int64"}), ", ".join(f"{n} string" for n in names) + ", tokens long, w double, rate double")
        rated = F.broadcast(rated)
    else:
        raked = _raked_in_spark(cells, names, goals, rounds, tolerance)
        low, high = 0.0, float(total) * 2.0**60
        for _ in range(80):  # bisect the factor at which the expected tokens meet the budget
            mid = (low + high) / 2 if low else high / 2**20
            got = raked.agg(F.sum(F.least(F.col("tokens").cast("double"), F.col("w") * mid))).first()[0]
            low, high = (mid, high) if got < budget_share * total else (low, mid)
            if abs(got - budget_share * total) < 1e-9 * total:
                break
        rated = raked.withColumn("rate", F.least(F.lit(1.0), F.col("w") * high / F.col("tokens")))
    rated = rated.select(*[F.col(n).alias(f"{n}_") for n in names], (F.col("w") / F.col("tokens")).alias("per_token"), "rate")
    on = [F.col(n) == F.col(f"{n}_") for n in names]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("_id", "_text"))), 1, 8), 16, 10).cast("double") / 2.0**32
    probability = F.when(F.col("_n") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    new = {"n_tokens": F.col("_n"), "weight": F.coalesce(F.col("_n") * F.col("per_token"), F.lit(0.0)), "probability": probability, "kept": draw < probability}
    old = [F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    return d.join(rated, on, "left").select(*old, *[c.alias(n) for n, c in new.items()])
