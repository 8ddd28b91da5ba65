"""Running totals, row numbers and exact quantiles over whole tables, without a task that sees the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.sources.scratch import written


def running_totals(df: DataFrame, order: tuple[str, ...], values: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each named value, its sum over all rows of the group ``by`` up to this one in ``order``, which must be unique.

    Rows are dealt out by ranges of the order and summed inside each; what precedes a range comes from a
    table of one row a range (and group). A group of any size is spread over the ranges it lies in.
    """
    adds = {n: f"_add_{n}" for n in values}
    dealt = df.withColumns({a: values[n] for n, a in adds.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    ranges = dealt.groupBy(*by, "_range").agg(*[F.sum(a).alias(f"_sum{a}") for a in adds.values()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and group
    ranges = ranges.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_of_range"), *[F.coalesce(F.sum(f"_sum{a}").over(earlier), F.lit(0)).alias(f"_before{a}") for a in adds.values()])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.col("_range") == F.col("_of_range"))
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(ranges if by else F.broadcast(ranges), same)
    summed = summed.withColumns({n: F.sum(a).over(inside) + F.col(f"_before{a}") for n, a in adds.items()})
    return summed.select(*[c for c in df.columns if c not in values], *values)


def running_total(df: DataFrame, order: tuple[str, ...], value: Column, out: str = "total") -> DataFrame:
    """``running_totals`` of one value over the whole table."""
    return running_totals(df, order, {out: value})


def numbered(df: DataFrame, order: tuple[str, ...], out: str = "number") -> DataFrame:
    """``df`` with ``out``, the place of each row in ``order``, from 1."""
    return running_total(df, order, F.lit(1).cast("long"), out)


def exact_quantiles(df: DataFrame, by: tuple[str, ...], value: str, quantiles: tuple[float, ...], times: str | None = None) -> DataFrame:
    """(by, q): array of the quantiles of each group, linear between neighbours; nulls are left out, and groups of nothing else.

    Equal values are folded into a count first; ``times`` says how often a row of a folded table counts. No buffer ever holds a group's values.
    """
    folded = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    at = running_total(folded, (*by, "_v"), F.col("_n"), "_to")
    groups = at.groupBy(*by).agg(F.sum("_n").alias("_all"), F.min(F.col("_to") - F.col("_n")).alias("_from"))
    named = groups.select(*[F.col(c).alias(f"_{c}") for c in by], "_all", "_from")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    rows = at.join(named, same) if by else at.crossJoin(F.broadcast(named))  # without groups one row; else Spark goes by the size
    last = F.col("_to") - F.col("_from")  # places from 1 of the value inside its group
    holds = lambda place: (last - F.col("_n") < place) & (place <= last)
    out = []
    for q in quantiles:
        place = 1 + (F.col("_all") - 1) * q
        out += [F.max(F.when(holds(F.floor(place)), F.col("_v"))).alias(f"_lo{len(out)}"), F.max(F.when(holds(F.ceil(place)), F.col("_v"))).alias(f"_hi{len(out) + 1}")]
    a = rows.groupBy(*by).agg(F.first("_all").alias("_all"), *out)
    value_at = lambda i, q: F.col(f"_lo{2 * i}") + (F.col(f"_hi{2 * i + 1}") - F.col(f"_lo{2 * i}")) * ((F.col("_all") - 1) * q - F.floor((F.col("_all") - 1) * q))
    return a.select(*by, F.array(*[value_at(i, q) for i, q in enumerate(quantiles)]).alias("q"))
