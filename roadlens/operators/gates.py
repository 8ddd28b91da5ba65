"""Contract checks whose results are rows, joins with proof of their keys, and lineage of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows, broken): one pass for all rules; a null condition is broken."""
    a = df.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return a.unpivot(["rows"], list(rules), "rule", "broken").select("rule", "rows", "broken")


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_keys(df: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def key_differences(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys of one table only, with ``side``."""
    left, right = a.select(*keys).withColumn("_a", F.lit(True)), b.select(*keys).withColumn("_b", F.lit(True))
    j = left.join(right, list(keys), "full_outer").where("_a is null or _b is null")
    return j.select(*keys, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def fingerprint(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Order-free identity of a table's keys: count, and sum and exclusive or of two independent 60-bit hashes per row. A null key hashes as the text \\N."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys]))
    h = [F.conv(F.substring(text, at, 15), 16, 10).cast("long") for at in (1, 17)]
    return df.agg(F.count("*").alias("rows"), *[F.sum(x.cast("decimal(38,0)")).cast("string").alias(f"sum{i}") for i, x in enumerate(h)], *[F.bit_xor(x).alias(f"xor{i}") for i, x in enumerate(h)])


def join_one_to_one(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``a`` with ``b`` and ``matches``, the rows of ``b`` that hold the key: anything but 1 breaks the contract, and shows."""
    n = b.withColumn("matches", F.count("*").over(Window.partitionBy(*keys)))
    return a.join(n, list(keys), "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))


def asof_nearest(left: DataFrame, right: DataFrame, by: str, tolerance: int) -> DataFrame:
    """``left`` (by, id, t) with the row of ``right`` (by, r_id, r_t) nearest in time within ``tolerance``; the earlier one on a tie.

    A union in time order finds both neighbours, so no pair is made that is not kept. The one after comes
    from backward order: its frame grows by a row, where one that shrinks would be read anew for each row.
    """
    u = left.select(by, "t", "id", F.lit(None).cast("long").alias("r_id")).unionByName(right.select(by, F.col("r_t").alias("t"), F.lit(None).cast("long").alias("id"), "r_id"))
    past, to_come = (Window.partitionBy(by).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("t"), F.desc("t")))
    seen = F.when(F.col("r_id").isNotNull(), F.struct("t", "r_id"))
    u = u.withColumns({"b": F.last(seen, True).over(past), "a": F.last(seen, True).over(to_come)}).where("id is not null")
    u = u.withColumns({"db": F.col("t") - F.col("b.t"), "da": F.col("a.t") - F.col("t")})
    first = F.col("db").isNotNull() & (F.col("da").isNull() | (F.col("db") <= F.col("da")))
    d = F.when(first, F.col("db")).otherwise(F.col("da"))
    ok = d <= tolerance
    return u.select(by, "id", "t", F.when(ok, F.when(first, F.col("b.t")).otherwise(F.col("a.t"))).alias("r_t"), F.when(ok, d).alias("distance"))


def plausible(df: DataFrame, ranges: dict[str, tuple[float, float]], keys: tuple[str, ...], most: float = 0.05) -> DataFrame:
    """``df`` with cells out of range made null, and ``rejected``: columns of the group with more than ``most`` such cells or no value at all."""
    w = Window.partitionBy(*keys)
    bad, out = [], {}
    for c, (lo, hi) in ranges.items():
        wrong = F.coalesce(~F.col(c).between(lo, hi), F.lit(False))
        share = F.avg(wrong.cast("double")).over(w)
        empty = F.count(F.when(~wrong, F.col(c))).over(w) == 0
        bad.append(F.when((share > most) | empty, F.lit(c)))
        out[c] = F.when(~wrong, F.col(c))
    return df.withColumn("rejected", F.array_join(F.array_compact(F.array(*bad)), ",")).withColumns(out)


def intake(files: DataFrame, least_rows: int, least_seconds: int) -> DataFrame:
    """(file, code) from (file, rows, first_second, last_second, missing): the first check that fails, by order; durations may pass midnight."""
    d = F.col("last_second") - F.col("first_second")
    d = F.when(d < 0, d + 86400).otherwise(d)
    code = F.when(F.col("missing") > 0, "missing_values").when(F.col("rows") < least_rows, "too_few_rows").when(d < least_seconds, "too_short").otherwise("ok")
    return files.select("file", "rows", d.alias("seconds"), code.alias("code"))


def run_manifest(stage: str, df: DataFrame) -> DataFrame:
    """(stage, column, type, rows, nulls) of a table: one aggregate."""
    types = dict(df.dtypes)
    a = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in types])
    out = a.unpivot(["rows"], list(types), "column", "nulls")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), F.col("column"))
    return out.select(F.lit(stage).alias("stage"), "column", kind.alias("type"), "rows", "nulls")


def dataset_identity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, sums and exclusive ors of row hashes): a row a table. The same whatever the files, their order and the order of rows; no file is read whole."""
    each = [fingerprint(df, tuple(df.columns)).select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


def verify(identity: DataFrame, recorded: DataFrame) -> DataFrame:
    """Each recorded table with ``verdict``: ok, changed or missing; tables that nothing records are ``unrecorded``. A row a table."""
    marks = ("rows", "sum0", "sum1", "xor0", "xor1")
    now = identity.select(F.col("table").alias("t"), *[F.col(m).alias(f"now_{m}") for m in marks])
    j = recorded.join(now, F.col("table") == F.col("t"), "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"now_{m}")) for m in marks])
    verdict = F.when(F.col("t").isNull(), "missing").when(F.col("table").isNull(), "unrecorded").when(same, "ok").otherwise("changed")
    return j.select(F.coalesce("table", "t").alias("table"), verdict.alias("verdict"))
