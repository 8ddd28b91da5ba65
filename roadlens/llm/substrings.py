"""Substring dedup by hashing lines, the sentences in them, and runs of short ones: the earliest ranked occurrence of each unit stays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from roadlens.llm.common import LOWER, UPPER, written

#: A single mark ends a sentence where one space follows it; that space becomes a line end, so offsets stay.
_SENTENCE = re.compile(r"([^.!?\x20\x09-\x0D][.!?])\x20")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_TO_LOWER = str.maketrans(UPPER, LOWER)

def units(text: str | None, least_words: int) -> Iterator[tuple[int, int, int, bool, str]]:
    """(start, end, words, whether it is a run of several lines or sentences, normal form) of each unit; code points, ends exclusive.

    A line or sentence of at least ``least_words`` words is a unit. A shorter one is read with its neighbours:
    the shortest run of lines and sentences that begins with it and holds so many words is a unit, and so is
    the shortest that ends with it. So a repeated passage of so many words is caught, however short its parts.
    A text of fewer words in all, but not none, is one unit.
    """
    if not text:
        return
    at, parts = 0, []
    for unit in _SENTENCE.sub("\\1\n", text).split("\n"):
        w = _WORDS.findall(unit)
        if w:
            parts.append((at, at + len(unit), len(w), " ".join(w).translate(_TO_LOWER)))
        at += len(unit) + 1
    runs = set()
    if parts and sum(p[2] for p in parts) < least_words:
        runs.add((0, len(parts) - 1))
    for i, (start, end, n, form) in enumerate(parts):
        if n >= least_words:
            yield start, end, n, False, form
            continue
        for step in (1, -1):
            j, words = i, n
            while words < least_words and 0 <= j + step < len(parts):
                j += step
                words += parts[j][2]
            if words >= least_words:
                runs.add((min(i, j), max(i, j)))
    for i, j in sorted(runs):
        yield parts[i][0], parts[j][1], sum(x[2] for x in parts[i : j + 1]), i < j, " ".join(x[3] for x in parts[i : j + 1])


def _meets(these: Column) -> Column:
    """Whether a unit overlaps one of ``these`` in its row, itself included. Both frames grow from an end of the row: one that shrinks would be read anew for each unit."""
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    until, since = F.max(F.when(these, F.col("end"))).over(before), F.min(F.when(these, F.col("start"))).over(after)
    return F.coalesce(until > F.col("start"), F.lit(False)) | F.coalesce(since < F.col("end"), F.lit(False))


def removed_units(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, least_words: int = 8, frequent: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """A row per unit to remove: doc_id, start, end, n_words, and kept_doc_id, kept_start and kept_end, where its first occurrence stands.

    Units are lines, split further at ends of sentences, since a passage may be copied into the midst
    of a line, and runs of short ones; see ``units``. Units are equal if their words are, A-Z in either
    case and white space of any kind and length. Occurrences rank by id, then by the MD5 of the whole text,
    then by row, then by offset: rows that repeat an id, or have none, hold occurrences of their own. Null ids
    come last. The first occurrence of each unit stays, the others go, in two steps, so that what stays is never
    cut: first lines and sentences, which do not overlap; then units that are runs anywhere, unless their first
    occurrence has been cut by the first step, or they overlap a place that stays in their own row. Removed units
    may overlap each other and are listed each. Null and blank texts have no units; other columns are ignored; ids
    may be of any type that can be sorted. ``row_col``: a long that tells rows apart, returned as ``row`` if given.

    Only counts and minima are grouped by digest, pre-aggregated, so a unit that a third of all rows share
    meets in no task; overlaps are looked for within a row. Units that stand more than ``frequent`` times are
    joined by broadcast, as many times more in large tables as keep them to ``broadcast_rows`` (some 80 bytes
    each); all others by shuffle.
    """
    columns = ["doc_id", "tie", "row", "start", "end", "n_words", "run", "digest"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            found = []
            for doc, tie, row, text in zip(batch["doc_id"].tolist(), batch["tie"].tolist(), batch["row"].tolist(), batch["text"].tolist()):
                found += [(doc, tie, row, s, e, n, run, digest(form.encode("utf-8", "surrogatepass"))) for s, e, n, run, form in units(text, least_words)]
                if len(found) > 100_000:
                    yield pd.DataFrame(found, columns=columns)
                    found = []
            yield pd.DataFrame(found, columns=columns)

    kind = docs.select(id_col).schema[0].dataType
    tie = F.conv(F.substring(F.md5(F.col(text_col)), 1, 15), 16, 10).cast("long")
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), tie.alias("tie"), (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("row"), F.col(text_col).alias("text"))
    found = d.mapInPandas(cut, "doc_id string, tie long, row long, start int, end int, n_words int, run boolean, digest binary")
    found = written(found.withColumn("doc_id", F.col("doc_id").cast(kind)), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "row", "start", "end")
    repeated = found.groupBy("digest").agg(F.min(rank).alias("first"), F.max("run").alias("runs"), F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated, "repeated-units")
    often = max(frequent, found.count() // max(1, broadcast_rows))  # so at most ``broadcast_rows`` units stand more often
    hot, rare = F.broadcast(repeated.where(F.col("n") > often)), repeated.where(F.col("n") <= often)
    rest = found.join(hot, "digest").unionByName(found.join(hot.select("digest"), "digest", "left_anti").join(rare, "digest"))
    rest = rest.withColumn("stays", (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start")))
    rest = written(rest.withColumn("cut", _meets(~F.col("stays") & ~F.col("runs"))), "placed-units")
    spoilt = rest.where("runs AND stays AND cut").select("digest", "n")
    of_runs = [rest.where("runs").where(c).join(side(spoilt.where(c)).select("digest"), "digest", "left_anti") for c, side in ((F.col("n") > often, F.broadcast), (F.col("n") <= often, lambda df: df))]
    plain = rest.where("NOT runs")
    second = of_runs[0].unionByName(of_runs[1]).unionByName(plain.where("stays")).withColumn("cut", _meets(F.col("stays")))
    rest = plain.where("NOT stays").unionByName(second.where("NOT stays AND NOT cut"))
    kept = [F.col(f"first.{c}").alias(f"kept_{c}") for c in ("doc_id", "start", "end")]
    return rest.select("doc_id", "start", "end", "n_words", *kept, *(["row"] if row_col else []))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 8) -> DataFrame:
    """``docs`` with ``text`` less its removed units and ``removed``, in the place of a column of that name: an array of their (start, end) in the original, which may overlap; null if none.

    Rows are numbered in a written copy, so that rows which share an id are cut each by their own offsets.
    """
    rows = written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("own")), "numbered")
    plain = rows.select(F.col("row")[id_col].alias("doc_id"), F.col("row")[text_col].alias("text"), "own")
    gone = removed_units(plain, row_col="own", least_words=least_words)
    gone = gone.groupBy(F.col("row").alias("own")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    out = rows.join(gone, "own", "left")

    @pandas_udf("string")
    def less(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, cuts):
            if text is None or cuts is None or not len(cuts):
                return text
            parts, at = [], 0
            for c in cuts:
                parts.append(text[at : max(at, c["start"])])
                at = max(at, c["end"] + 1)  # with the line end or space after it
            return "".join([*parts, text[at:]])

        return pd.Series([one(t, c) for t, c in zip(texts, spans)], dtype=object)

    kept = [less(F.col("row")[c], F.col("cuts")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "removed"]
    return out.select(*kept, F.col("cuts").alias("removed"))
