"""Benchmark decontamination by winnowing, with DataFrame functions only.

A k-gram hash of words is a fingerprint where it is the smallest of ``span - k + 1`` consecutive
hashes. Documents and items that share ``span`` words share such a fingerprint, so joining the
fingerprints finds every shared span. Hits are then extended: each window of ``span`` words around a
joined fingerprint is compared, word for word, with the items' windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import ascii_lower, bytes_of, let, written

#: What lies between words, in a text whose A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def fingerprints(w: Column, span: int, k: int) -> Column:
    """Array of (h, pos) winnowed from the words ``w``; pos counts from 1. Empty for fewer than ``span`` words.

    Every position that holds the smallest hash of some window is kept, ties included.
    """
    n, width = F.size(w), span - k + 1
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("pos"))
    hashes = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    if width == 1:
        picked = F.transform(hashes, lambda h, i: pair(h, i + 1))
    else:
        picked = let(
            hashes,
            lambda hs: let(
                F.transform(F.sequence(F.lit(1), n - (span - 1)), lambda s: F.array_min(F.slice(hs, s, width))),
                lambda least: F.filter(
                    F.transform(hs, lambda h, i: pair(h, i + 1)),
                    lambda x: F.array_contains(
                        F.slice(least, F.greatest(x["pos"] - (width - 1), F.lit(1)), F.least(x["pos"], F.lit(width))), x["h"]
                    ),
                ),
            ),
        )
    return F.when(n >= span, picked).otherwise(F.array().cast("array<struct<h:bigint,pos:int>>"))


def item_windows(benchmark: DataFrame, span: int, item_col: str, text_col: str) -> DataFrame:
    """(size, window, items): each distinct window with the sorted ids, as strings, of the items that hold it."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(span)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    each = w.select("item", "size", "w", F.explode(starts).alias("s"))
    each = each.select("item", "size", F.array_join(F.slice("w", F.col("s"), F.col("size")), " ").alias("window")).distinct()
    return each.groupBy("size", "window").agg(F.array_sort(F.collect_list("item")).alias("items"))


def _window_hits(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, span: int, k: int, broadcast_bytes: int) -> DataFrame | None:
    """(doc_id, th, run, items) for each window of an item that occurs in a row of ``docs`` (doc_id, text, th); run is where it stands. None if no item has words.

    Windows of all sizes are looked for in one pass: those of ``span`` words by winnowed k-grams, shorter
    items by a hash of the whole of them.
    """
    windows = written(item_windows(benchmark, span, item_col, text_col), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # span rows at most
    if not sizes:
        return None
    small = bytes_of(windows, "window", "items") <= broadcast_bytes
    side = F.broadcast if small else lambda df: df

    def marks(w: Column) -> Column:
        """Array of (size, h, pos) of all sizes."""

        def of(n: int) -> Column:
            return F.transform(fingerprints(w, n, k if n == span else n), lambda f: F.struct(F.lit(n).alias("size"), f["h"].alias("h"), f["pos"].alias("pos")))

        return F.flatten(F.array(*map(of, sizes)))

    own = windows.withColumn("w", F.split("window", " ")).withColumn("f", F.explode(marks(F.col("w")))).where(F.col("f.size") == F.col("size"))
    prints = own.select("size", F.col("f.h").alias("h")).distinct()
    tokens = docs.select("doc_id", "th", words(F.col("text")).alias("w"))
    found = tokens.withColumn("f", marks(F.col("w")))
    if small:
        found = found.select("doc_id", "th", "w", F.explode_outer("f").alias("f")).select("doc_id", "th", "w", "f.size", "f.h", "f.pos").join(F.broadcast(prints), ["size", "h"])
    else:  # the words stay behind; only documents with a hit are read again
        found = found.select("doc_id", "th", F.explode_outer("f").alias("f")).select("doc_id", "th", "f.size", "f.h", "f.pos").join(prints, ["size", "h"])
        found = found.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "size", "pos").distinct()
        found = tokens.dropDuplicates(["doc_id", "th"]).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")))
    reach = F.when(F.col("size") == span, span - k).otherwise(0)
    first = F.greatest(F.col("pos") - reach, F.lit(1))
    last = F.least(F.col("pos"), F.size("w") - (F.col("size") - 1))
    near = found.select("doc_id", "th", "size", first.alias("first"), F.slice("w", first, last - first + F.col("size")).alias("w"))
    near = near.select("doc_id", "th", "size", "first", "w", F.posexplode(F.sequence(F.lit(1), F.size("w") - (F.col("size") - 1))).alias("o", "s"))
    near = near.select("doc_id", "th", "size", (F.col("first") + F.col("o")).alias("at"), F.array_join(F.slice("w", F.col("s"), F.col("size")), " ").alias("window"))
    return near.join(side(windows), ["size", "window"]).select("doc_id", "th", F.struct(F.col("at"), (F.col("at") + F.col("size")).alias("end")).alias("run"), "items")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 10,
    k: int = 5,
    broadcast_bytes: int = 64_000_000,
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and ``items``, the sorted item ids.

    Null and empty texts have no words; an item without words matches nothing; an item of fewer than
    ``span`` words is one window. Rows that repeat a document, and rows that share an id, each get
    their own row; a null id is kept. An empty benchmark leaves every document clean. Other columns
    of either table are ignored. The items' fingerprints and windows are broadcast where the windows, with
    the ids of all items that hold them, have at most ``broadcast_bytes``, and joined by shuffle beyond that.
    """
    docs = documents.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    hits = _window_hits(docs, benchmark, item_col, item_text_col, span, k, broadcast_bytes)
    counted = docs.select("doc_id", "th", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    if hits is None:
        joined = counted.withColumn("n_hit", F.lit(None).cast("long")).withColumn("items", F.lit(None).cast("array<string>"))
    else:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        covered = F.aggregate(
            F.array_sort(F.collect_set("run")),
            start,
            lambda a, x: F.struct(
                F.greatest(a["end"], x["end"]).alias("end"),
                (a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["at"]), F.lit(0))).alias("n"),
            ),
        )["n"]
        hits = written(hits.distinct(), "hits")  # a passage that a document repeats, or that many windows share, counts once from here on
        runs = hits.groupBy("doc_id", "th").agg(covered.alias("n_hit"))
        items = hits.select("doc_id", "th", F.explode("items").alias("item")).distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("item")).alias("items"))
        per = runs.join(items.select(F.col("doc_id").alias("i_"), F.col("th").alias("t_"), "items"), F.col("doc_id").eqNullSafe(F.col("i_")) & F.col("th").eqNullSafe(F.col("t_")))
        per = per.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "n_hit", "items")
        joined = counted.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        items.alias("items"),
    )


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5,
    broadcast_bytes: int = 64_000_000, broadcast_rows: int = 500_000,
) -> DataFrame:
    """``documents`` without those that share a window with an item; see ``contamination``. Their keys are broadcast up to ``broadcast_rows``."""
    docs = documents.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    hits = _window_hits(docs, benchmark, item_col, item_text_col, span, k, broadcast_bytes)
    if hits is None:
        return documents
    keys = written(hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct(), "contaminated")
    side = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col(doc_col).alias("doc_id"), F.xxhash64(text_col).alias("th"))
    return rows.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")), "left_anti").select("row.*")
