"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours in the order share long runs of bits, and dealt
out by ranges of it. Each range is a node of the index: the masked bit pattern that all below it share.
Runs of ranges are folded into upper nodes, and inside a range runs of fingerprints into lower ones. A
search goes down from the top, adds up the bits in which the fingerprint differs from what a node's
members share, and leaves out each group whose accumulated differences exceed the radius. The upper
nodes, one for some 65,536 fingerprints, are known to every task; a fingerprint goes to its own range and
to those later ones that the upper nodes do not rule out.

Texts of a given shingle similarity, which differ in too many of 64 bits, are found by ``deduplicated``:
longer fingerprints, many narrow masked blocks as uppermost nodes, and an exact comparison of shingles.
Links that those miss are found by the shingles themselves: texts similar enough share one of their first ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from roadlens.llm.common import LOWER, UPPER, bytes_of, roots_of, whole_keys, written
from roadlens.llm.components import components

_TO_LOWER = str.maketrans(UPPER, LOWER)
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: The bits of each byte, least significant first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SLOTS = (np.arange(8) * 256).astype(np.int64)
#: Of the long fingerprints: 48 blocks of 16 bits, three thirds of 256.
PRINT_WORDS = 12
_SALTS = np.array([0x9E3779B97F4A7C15 * (i + 1) % 2**64 for i in range(PRINT_WORDS)], dtype=np.uint64)
_LONG_SLOTS = (np.arange(8 * PRINT_WORDS) * 256).astype(np.int64)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text, unsigned: a bit is set if set in over half of its shingles' XXH64 (seed 42)."""
    if not text:
        return 0
    w = _WORDS.findall(text.translate(_TO_LOWER))
    if not w:
        return 0
    h, parts = xxhash.xxh64_intdigest, [w] if len(w) < shingle else zip(*(w[i:] for i in range(shingle)))
    hashes = np.array([h(" ".join(p), 42) for p in parts], dtype="<u8")
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _SLOTS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """``simhash`` as a signed long; zero for null and for texts without words."""

    @pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([simhash(t, shingle) for t in s], dtype=np.uint64).view(np.int64))

    return of(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each word stands in the Gray code: the inverse of ``n ^ (n >> 1)``."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayTree:
    """Nodes (pattern, mask of the bits that all below share), in Gray order, under upper nodes of ``fan`` each."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray, fan: int = 8):
        self.levels, self.fan = [(pattern, mask)], fan
        while len(self.levels[-1][0]) > fan:
            pattern, mask = self.levels[-1]
            starts = np.arange(0, len(pattern), fan)
            ones = np.bitwise_and.reduceat(pattern & mask, starts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((ones, ones | zeros))

    def search(self, prints: np.ndarray, radius: int, after: np.ndarray | None = None, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(index of a print, leaf) for each leaf whose members can be within ``radius`` of it; of leaves past ``after`` only, where that is given."""
        a, b, fan = [np.empty(0, np.int64)], [np.empty(0, np.int64)], self.fan
        for lo in range(0, len(prints), block):
            q = np.arange(lo, min(lo + block, len(prints)))
            at = np.tile(np.arange(len(self.levels[-1][0])), len(q))
            q = np.repeat(q, len(self.levels[-1][0]))
            for depth in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[depth]
                if after is not None:
                    reach = (at + 1) * fan**depth - 1 > after[q]
                    q, at = q[reach], at[reach]
                near = np.bitwise_count((prints[q] ^ pattern[at]) & mask[at]) <= radius
                q, at = q[near], at[near]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    q = np.repeat(q, fan)
                    at = (at[:, None] * fan + np.arange(fan)).ravel()
                    q, at = q[at < below], at[at < below]
            a.append(q)
            b.append(at)
        return np.concatenate(a), np.concatenate(b)


def gray_leaves(prints: np.ndarray) -> GrayTree:
    """The tree over single ``prints`` (uint64); its leaves are in Gray order."""
    leaves = prints[np.argsort(gray_rank(prints), kind="stable")]
    return GrayTree(leaves, np.full(len(leaves), ~np.uint64(0)))


def gray_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the distinct ``prints`` (uint64) that differ in 1 to ``radius`` bits."""
    tree = gray_leaves(prints)
    leaves = tree.levels[0][0]
    i, j = tree.search(leaves, radius, after=np.arange(len(leaves)))
    return leaves[i], leaves[j]


def _gray_order(fp: Column) -> Column:
    """A signed long that sorts as the Gray rank of ``fp`` does unsigned."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _spanning_links(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """A spanning set of the links between places a and b of ``names``."""
    root = roots_of(len(names), a, b)
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"a": names[moved].view(np.int64), "b": names[root[moved]].view(np.int64)})


def similar_fingerprints(prints: DataFrame, radius: int = 2, members: int = 65_536, ranges: int = 64, least: int = 256) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column ``fp`` (long) that connect just what differing in ``radius`` bits or fewer connects.

    The Gray order is cut into ``ranges`` of about ``least`` fingerprints or more, and into as many more as keep
    them at ``members``: the rows that a fingerprint is dealt to grow with the square of the logarithm of their number. The driver sees a range's node only: 24 bytes for all of its members. A task
    holds the fingerprints of one range; those that visit it pass by in batches.
    """
    spark, n = prints.sparkSession, prints.count()
    ranges = max(1, -(-n // members), min(ranges, n // least))
    ranged = prints.select("fp", _gray_order(F.col("fp")).alias("rank")).repartitionByRange(ranges, "rank").select("fp", F.spark_partition_id().alias("range"))
    ranged = written(ranged, "gray-order")
    nodes = ranged.groupBy("range").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")).orderBy("range").toPandas()
    numbers = nodes["range"].to_numpy(dtype=np.int64)
    ones, some = (nodes[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("ones", "any"))
    upper = spark.sparkContext.broadcast((numbers, GrayTree(ones, ~(ones ^ some))))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, tree = upper.value
        for batch in batches:
            fp, own = batch["fp"].to_numpy(), batch["range"].to_numpy()
            q, at = tree.search(fp.view(np.uint64), radius, after=np.searchsorted(numbers, own))
            yield pd.DataFrame({"range": np.r_[own, numbers[at]], "away": np.r_[np.zeros(len(fp), bool), np.ones(len(q), bool)], "fp": np.r_[fp, fp[q]]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, tree = None, [], None
        for batch in batches:
            key, away, fp = batch["range"].to_numpy(), batch["away"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (away[1:] != away[:-1])]) if len(key) else []
            for s, e in zip(starts, [*starts[1:], len(key)]):
                if key[s] != now:
                    if held and tree is None:
                        yield _own_links(gray_leaves(np.concatenate(held)), radius)
                    now, held, tree = key[s], [], None
                if not away[s]:
                    held.append(fp[s:e])
                    continue
                if tree is None:
                    tree = gray_leaves(np.concatenate(held))
                    yield _own_links(tree, radius)
                q, at = tree.search(fp[s:e], radius)
                yield _spanning_links(np.r_[fp[s:e], tree.levels[0][0]], q, at + (e - s))
        if held and tree is None:
            yield _own_links(gray_leaves(np.concatenate(held)), radius)

    dealt = ranged.mapInPandas(deal, "range int, away boolean, fp long").repartition(ranges, "range").sortWithinPartitions("range", "away")
    return dealt.mapInPandas(search, "a long, b long").distinct()


def _own_links(tree: GrayTree, radius: int) -> pd.DataFrame:
    leaves = tree.levels[0][0]
    return _spanning_links(leaves, *tree.search(leaves, radius, after=np.arange(len(leaves))))


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    text = F.col(text_col)
    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), fingerprint(text, shingle).alias("fp")), "simhash")


def _with_roots(classes: DataFrame, radius: int) -> DataFrame:
    """``classes``, a row per ``fp``, with ``root``, a fingerprint that names the component."""
    roots = components(similar_fingerprints(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links.

    Null and empty texts, and those without words, have fingerprint zero and link like any other;
    rows that repeat a document or an id each keep their row; a row with a null id keeps it and never
    names a component unless the whole component has none. Other columns are ignored. Equal
    fingerprints are folded into one before the search, so copies cost nothing more.
    """
    prints = _prints(docs, id_col, text_col, shingle)
    linked = _with_roots(written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes"), radius)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(of, prints.fp == F.col("f"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """XXH64 (seed 42) of the distinct word shingles of a text, sorted; a text of fewer words is one shingle, one of none has none."""
    w = _WORDS.findall((text or "").translate(_TO_LOWER))
    if not w:
        return np.empty(0, np.uint64)
    h, parts = xxhash.xxh64_intdigest, [w] if len(w) < shingle else zip(*(w[i:] for i in range(shingle)))
    return np.unique(np.array([h(" ".join(p), 42) for p in parts], dtype=np.uint64))


def long_print(hashes: np.ndarray, block: int = 20_000) -> np.ndarray:
    """Fingerprint of ``PRINT_WORDS`` 64-bit words of a shingle set: each hash is mixed anew for each word."""
    counts = np.zeros(8 * PRINT_WORDS * 256, np.int64)
    for lo in range(0, len(hashes), block):
        h = hashes[lo : lo + block, None] + _SALTS
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8 * PRINT_WORDS) + _LONG_SLOTS).ravel(), minlength=len(counts))
    return np.packbits((counts.reshape(-1, 256) @ _BITS).ravel() * 2 > len(hashes), bitorder="little").view("<u8")


def parity_bits(hashes: np.ndarray) -> bytes:
    """A bit for each place that an odd number of the ``hashes`` fall on; as many places as hashes or more, a power of two of 64 at least."""
    places = 64 << max(0, (len(hashes) - 1 >> 6).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At most as many as the members that only one of two sets has, told from their ``parity_bits``."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_print(text: Column, shingle: int) -> Column:
    """(sh, n, bits, w0, w1, ...): a hash of the text's shingle set, zero where it is empty, its size, ``parity_bits`` and the words of its ``long_print``."""

    @pandas_udf("sh long, n long, bits binary, " + ", ".join(f"w{i} long" for i in range(PRINT_WORDS)))
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            keys, words = np.zeros(len(s), np.uint64), np.zeros((len(s), PRINT_WORDS), np.uint64)
            size, bits = np.zeros(len(s), np.int64), [b""] * len(s)
            for i, t in enumerate(s):
                own = shingle_set(t, shingle)
                if len(own):
                    keys[i], words[i] = xxhash.xxh64_intdigest(own.tobytes(), 42), long_print(own)
                    size[i], bits[i] = len(own), parity_bits(own)
            yield pd.DataFrame({"sh": keys.view(np.int64), "n": size, "bits": bits} | {f"w{i}": words[:, i].view(np.int64) for i in range(PRINT_WORDS)})

    return of(text)


def nodes(classes: DataFrame, tables: range, *more: str) -> DataFrame:
    """(node, sh, x0, ..., x3 and ``more``) for each of ``tables``: the masked pattern, 14 bits of one 16-bit block of the long fingerprint, and a third of it that changes with the block."""
    third = PRINT_WORDS // 3
    cells = []
    for t in tables:
        block = F.shiftrightunsigned(F.col(f"w{t // 4}"), 16 * (t % 4)).bitwiseAND(F.lit(0x3FFF))
        cells.append(F.struct((block + F.lit(t << 14)).alias("node"), *[F.col(f"w{t % 3 * third + i}").alias(f"x{i}") for i in range(third)]))
    return classes.select("sh", *more, F.explode(F.array(*cells)).alias("c")).select("c.node", "sh", *[f"c.x{i}" for i in range(third)], *more)


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}x{i}").bitwiseXOR(F.col(f"{b}x{i}"))) for i in range(PRINT_WORDS // 3)), F.lit(0))


def star_pairs(classes: DataFrame, radius: int, dense: int = 32, tables: int = 8, broadcast_rows: int = 500_000) -> DataFrame:
    """(a, b): in each node of at least ``dense`` members the one of the smallest key, its leader, with each member near it.

    Leaders come from a pre-aggregated minimum, so a node that holds a third of all rows costs no more than
    its rows. Leaders are broadcast up to ``broadcast_rows`` (48 bytes each) and joined by shuffle beyond.
    """
    narrow = nodes(classes, range(tables))
    words = [f"x{i}" for i in range(PRINT_WORDS // 3)]
    leaders = narrow.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("sh", *words)).alias("l")).where(F.col("n") >= dense)
    leaders = written(leaders.select("node", F.col("l.sh").alias("leader"), *[F.col(f"l.{w}").alias(f"l{w}") for w in words]), "simhash-leaders")
    side = F.broadcast(leaders) if leaders.count() <= broadcast_rows else leaders
    near = narrow.join(side, "node").where((F.col("sh") != F.col("leader")) & (_distance("", "l") <= radius))
    return near.select(F.col("leader").alias("a"), F.col("sh").alias("b")).distinct()


def close_pairs(words: np.ndarray, ends: np.ndarray, group: np.ndarray, radius: int, first_radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j < ``ends[i]`` of other groups whose ``words`` differ in ``radius`` bits or fewer, and in ``first_radius`` within the first word; with their distance."""
    at = np.arange(len(words))
    a, b, far, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    first = np.ascontiguousarray(words[:, 0])
    while True:
        step += 1
        at = at[at + step < ends[at]]
        if not len(at):
            break
        i = at[np.bitwise_count(first[at] ^ first[at + step]) <= first_radius]
        i = i[group[i] != group[i + step]]
        d = np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1, dtype=np.int64)
        near = d <= radius
        a.append(i[near])
        b.append(i[near] + step)
        far.append(d[near])
    return np.concatenate(a), np.concatenate(b), np.concatenate(far)


def spanning(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Indices of a least spanning forest of the links a-b by ``far``: at any bound of ``far`` it connects what all links connect."""
    order = np.lexsort((b, a, far))
    a, b = a[order], b[order]
    root, rank, chosen = np.arange(n), np.arange(len(a)), np.empty(0, np.int64)
    while True:
        apart = np.flatnonzero(root[a] != root[b])
        if not len(apart):
            return order[chosen]
        best = np.full(n, len(a))
        np.minimum.at(best, root[a[apart]], rank[apart])
        np.minimum.at(best, root[b[apart]], rank[apart])
        chosen = np.union1d(chosen, best[best < len(a)])
        root = roots_of(n, a[chosen], b[chosen])


def nearest_forest(words: np.ndarray, group: np.ndarray, radius: int, cells: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` that span all groups of one node, least ones first, without a list of pairs.

    In each round every row outside the largest group looks for the nearest row of another group; of each
    group the nearest such link is taken, and groups that meet become one.
    """
    group = np.unique(group, return_inverse=True)[1]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    idle = np.zeros(len(words), bool)  # rows with no other group in reach: nor will there be one when groups grow
    while True:
        asking = np.flatnonzero((group != np.bincount(group).argmax()) & ~idle)
        if not len(asking):
            break
        to, far = np.empty(len(asking), np.int64), np.empty(len(asking), np.int64)
        step = max(1, cells // len(words))
        for lo in range(0, len(asking), step):
            q = asking[lo : lo + step]
            d = np.zeros((len(q), len(words)), np.int16)
            for w in range(words.shape[1]):
                d += np.bitwise_count(words[q, w][:, None] ^ words[:, w])
            d[group[q][:, None] == group] = 9999
            to[lo : lo + step] = d.argmin(axis=1)
            far[lo : lo + step] = d[np.arange(len(q)), to[lo : lo + step]]
        idle[asking[far > radius]] = True
        asking, to, far = (x[far <= radius] for x in (asking, to, far))
        if not len(asking):
            break
        order = np.lexsort((to, asking, far))
        first = order[np.unique(group[asking[order]], return_index=True)[1]]
        a.append(asking[first])
        b.append(to[first])
        group = roots_of(group.max() + 1, group[asking[first]], group[to[first]])[group]
    return np.concatenate(a), np.concatenate(b)


def candidate_pairs(classes: DataFrame, radius: int = 64, first_radius: int = 22, small: int = 256, members: int = 32_768) -> DataFrame:
    """(a, b): pairs of ``sh`` of different groups whose long fingerprints are near, from ``classes`` (sh, g, w0, w1, ...), ``g`` being what is linked already.

    The nodes are masked patterns: 14 bits of each of the 48 16-bit blocks. Texts of similarity 0.8 differ
    in some 15 % of bits and meet in a node with a chance of 0.99; those that meet are compared over 256
    bits. Of a node's pairs a least spanning forest leaves it, so a large group gives no more links than it
    has members. Where members of a group of over ``members`` fill a node, they are dealt to several units
    of it, and the node's other rows to each.
    """
    third = [f"x{i}" for i in range(PRINT_WORDS // 3)]
    rows = nodes(classes, range(4 * PRINT_WORDS), "g")
    large = written(classes.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > members).select(F.col("g").alias("lg")), "simhash-large")  # a row for so many
    unit = F.col("node").cast("long")
    if not large.isEmpty():
        rows = rows.join(F.broadcast(large), F.col("g") == F.col("lg"), "left")
        split = rows.where("lg is not null").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > members)
        split = split.select(F.col("node").alias("hot"), F.ceil(F.col("n") / members).cast("int").alias("units"))
        rows = rows.join(F.broadcast(split), F.col("node") == F.col("hot"), "left")  # at most 48 for each ``members`` rows
        own = F.array(F.pmod(F.hash("sh"), F.col("units")))
        rows = rows.withColumn("u", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(0))).when(F.col("lg").isNotNull(), own).otherwise(F.sequence(F.lit(0), F.col("units") - 1))))
        unit = F.col("node") + F.col("u").cast("long") * (1 << 32)
    dealt = rows.select(unit.alias("unit"), "sh", "g", *third)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends in whole_keys(batches, "unit"):
            words, sh, g = frame[third].to_numpy().view(np.uint64), frame["sh"].to_numpy(), frame["g"].to_numpy()
            size = ends - starts
            few = np.repeat((size > 1) & (size <= small), size)
            at = np.flatnonzero(few)
            place = np.cumsum(few) - 1
            last = place[np.repeat(ends, size)[at] - 1] + 1
            i, j, far = close_pairs(words[at], last, g[at], radius, first_radius)
            groups = np.unique(np.stack([last, g[at]]), axis=1, return_inverse=True)[1].ravel() if len(at) else np.empty(0, np.int64)  # of each node
            kept = spanning(len(at), groups[i], groups[j], far)
            a, b = [at[i[kept]]], [at[j[kept]]]
            for s, e in zip(starts[size > small], ends[size > small]):
                i, j = nearest_forest(words[s:e], g[s:e], radius)
                a.append(i + s)
                b.append(j + s)
            a, b = sh[np.concatenate(a)], sh[np.concatenate(b)]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.repartition("unit").sortWithinPartitions("unit", "sh").mapInPandas(search, "a long, b long").distinct()


def alike_pairs(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text_col: str, shingle: int, similarity: float, often: int = 256, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of ``similarity`` or more, from one text of each of ``classes`` (sh, least).

    The left side may hold a key that a third of all pairs share. Texts of keys with over ``often`` pairs are
    few, and broadcast where they hold at most ``broadcast_bytes``; beyond that they are salted.
    """
    pairs = written(pairs, "simhash-pairs")
    named = pairs.select(F.col("a").alias("sh")).unionByName(pairs.select(F.col("b").alias("sh"))).distinct()
    wanted = classes.select("sh", F.col("least.th").alias("th")).join(named, "sh")
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t")).join(wanted, "th")
    texts = written(texts.groupBy("sh").agg(F.first("t").alias("t")), "simhash-texts")

    @pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        of = lru_cache(256)(lambda t: shingle_set(t, shingle))

        def one(s, t):
            x, y = of(s), of(t)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= similarity * (len(x) + len(y) - both) - 1e-9

        return pd.Series([one(s, t) for s, t in zip(left, right)], dtype=bool)

    left, right = (texts.select(F.col("sh").alias(k), F.col("t").alias(f"t_{k}")) for k in "ab")
    hot = written(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > often).select("a"), "simhash-often")  # a row for so many pairs
    told = pairs.join(right, "b")
    rare = told.join(F.broadcast(hot), "a", "left_anti").join(left, "a")
    if hot.isEmpty():
        both = rare
    else:
        own, much = left.join(F.broadcast(hot), "a", "left_semi"), told.join(F.broadcast(hot), "a", "left_semi")
        if bytes_of(own, "t_a") <= broadcast_bytes:
            frequent = much.join(F.broadcast(own), "a")
        else:
            salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
            frequent = much.withColumn("salt", F.pmod(F.hash("b"), F.lit(64))).join(salted, ["a", "salt"]).drop("salt")
        both = rare.unionByName(frequent)
    return both.where(alike("t_a", "t_b")).select("a", "b")


def first_shingles(hashes: np.ndarray, similarity: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a set's ``hashes`` the first, seldom ones first: as many that a set of that ``similarity`` or more has one of them among its own first.

    ``often`` are sorted hashes that come last, by ``counts``. Any order gives the same links; this one keeps what many sets hold out of it.
    """
    weight = np.zeros(len(hashes), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        weight = np.where(often[at] == hashes, counts[at], 0)
    n = len(hashes)
    return hashes[np.lexsort((hashes, weight))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def prefix_pairs(grouped: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, members: int = 2048, sampled: int = 8, least: int = 8, most: int = 500_000) -> DataFrame:
    """(a, b): every pair of ``sh`` of different groups that can have a Jaccard similarity of ``similarity``, from ``grouped`` (sh, g, n, bits, least).

    Two such sets share one of their first shingles in any order that holds for all. What stands before the first one shared is in one
    set only, so a pair is formed only where sizes and places in the order leave enough to share; of those, parity bits
    rule out more. No link is missed. Shingles that many texts hold are put last in the order. They are told from one text in ``sampled``, ``most`` of them at most, which bears on the work alone. A
    shingle that is held by over ``members`` texts all the same is dealt out as pairs of blocks.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    named = grouped.select("sh", "g", F.col("least.doc_id").alias("d_"), F.col("least.th").alias("th_"))

    def texts(classes: DataFrame) -> DataFrame:
        return text.join(classes, F.col("th").eqNullSafe(F.col("th_")) & F.col("d").eqNullSafe(F.col("d_"))).select("sh", "g", "t")

    def all_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["t"]:
                yield pd.DataFrame({"token": shingle_set(t, shingle).view(np.int64)})

    counted = texts(named.where(F.pmod("sh", F.lit(sampled)) == 0)).mapInPandas(all_shingles, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    told = counted.orderBy(F.desc("n"), "token").limit(most).toPandas()
    order = np.argsort(told["token"].to_numpy(dtype=np.int64).view(np.uint64))
    known = spark.sparkContext.broadcast((told["token"].to_numpy(dtype=np.int64).view(np.uint64)[order], told["n"].to_numpy(dtype=np.int64)[order]))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, counts = known.value
        many = often[counts * sampled > members]
        names, held, size = ("unit", "sh", "apart", "block", "size_place"), [], 0
        for batch in batches:
            for sh, g, t in zip(batch["sh"], batch["g"], batch["t"]):
                own = shingle_set(t, shingle)
                first = first_shingles(own, similarity, often, counts)
                unit, block, place = [first], [np.full(len(first), -1)], [np.arange(len(first))]
                for i in np.flatnonzero(np.isin(first, many)) if len(many) else []:
                    blocks = -(-int(counts[np.searchsorted(often, first[i])]) * sampled // members)
                    b, other = sh % blocks, np.arange(blocks)
                    cell = np.minimum(b, other) * blocks + np.maximum(b, other) + 1
                    unit.append(first[i] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    block.append(np.where(other == b, -1, b))
                    place.append(np.full(blocks, i))
                    block[0][i] = -2
                unit, block, place = (np.concatenate(x) for x in (unit, block, place))
                # what is zero for most rows, or small, takes no room in a shuffle: 48 bits tell units well enough, ``g`` is mostly ``sh``
                rows = np.stack([(unit >> np.uint64(16)).view(np.int64), np.full(len(unit), sh), np.full(len(unit), sh ^ g), block + 1, (len(own) << 32) + place])
                held.append(rows[:, block > -2])
                size += len(unit)
                if size > 50_000:
                    yield pd.DataFrame(dict(zip(names, np.concatenate(held, axis=1))))
                    held, size = [], 0
        if held:
            yield pd.DataFrame(dict(zip(names, np.concatenate(held, axis=1))))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends in whole_keys(batches, "unit"):
            sh, apart, block, size_place = (frame[c].to_numpy() for c in ("sh", "apart", "block", "size_place"))
            g, n = sh ^ apart, size_place >> 32
            most = (n - (size_place & 0xFFFFFFFF)) * (1 + similarity) + 1e-6  # what a set can share from here on, against what two must
            last, at, step, held, size = np.repeat(ends, ends - starts), np.arange(len(sh)), 0, [], 0
            while len(at):
                step += 1
                at = at[at + step < last[at]]
                at = at[most[at] >= similarity * (n[at] + n[at + step])]  # sizes rise
                i = at[most[at + step] >= similarity * (n[at] + n[at + step])]
                i = i[(g[i] != g[i + step]) & ((block[i] != block[i + step]) | (block[i] == 0))]
                held.append(np.stack([np.minimum(sh[i], sh[i + step]), np.maximum(sh[i], sh[i + step])]))
                size += len(i)
                if held and (size > 200_000 or not len(at)):
                    a, b = np.unique(np.concatenate(held, axis=1), axis=1) if size else held[0]
                    yield pd.DataFrame({"a": a, "b": b})
                    held, size = [], 0

    dealt = texts(named).mapInPandas(deal, "unit long, sh long, apart long, block long, size_place long")
    pairs = dealt.repartition("unit").sortWithinPartitions("unit", "size_place").mapInPandas(meet, "a long, b long").distinct()

    @pandas_udf("boolean")
    def may_be_alike(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        bound = (1 - similarity) / (1 + similarity) * n + 1e-6
        return pd.Series([least_difference(x, y) for x, y in zip(a, b)], dtype="int64", index=n.index) <= bound

    left, right = (grouped.select(F.col("sh").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").where(may_be_alike("bits_a", "bits_b", F.col("n_a") + F.col("n_b"))).select("a", "b")


def similar_texts(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, radius: int = 64) -> DataFrame:
    """(a, b): links that connect texts of ``classes`` (sh, least, n, bits, w0, ...) of a Jaccard similarity of ``similarity`` or more: just those that all such pairs connect.

    Dense nodes first give stars: their members against one leader each, compared exactly. What they
    link is one group from then on. The nodes of the fingerprints then give the near links between groups at
    little cost, and the first shingles all that are left between the groups that those make.
    """
    worded = classes.where("sh <> 0")

    def grouped(links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return worded.withColumn("g", F.col("sh"))
        of = worded.join(components(links), F.col("sh") == F.col("node"), "left").withColumn("g", F.coalesce("root", "sh")).drop("node", "root")
        return written(of, "simhash-grouped")

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        return written(alike_pairs(pairs, docs, classes, text_col, shingle, similarity), name)

    stars = alike(star_pairs(worded, radius), "simhash-stars")
    links = stars.unionByName(alike(candidate_pairs(grouped(stars), radius), "simhash-near"))
    return links.unionByName(alike(prefix_pairs(grouped(links), docs, id_col, text_col, shingle, similarity), "simhash-rest"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: that of the smallest id, then of the smallest hash of its text.

    Texts are linked if the sets of their word shingles have a Jaccard similarity of ``similarity`` or more;
    those without words are alike. Candidates come from long fingerprints, then, between the groups that these
    make, from shared first shingles, which leave none out; each is compared shingle by shingle. Null ids come last. Of rows that repeat the kept id and text one stays. The keys to remove are
    broadcast up to ``broadcast_rows`` (16 bytes each) and joined by shuffle beyond.
    """
    text = F.col(text_col)
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), set_print(text, shingle).alias("p"))
    words = [f"w{i}" for i in range(PRINT_WORDS)]
    prints = written(prints.select("doc_id", "th", "p.*"), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    classes = written(prints.groupBy("sh").agg(F.min(rank).alias("least"), *[F.min(c).alias(c) for c in ("n", "bits", *words)]), "simhash-classes")
    roots = components(similar_texts(docs, classes, id_col, text_col, shingle, similarity)).withColumnRenamed("node", "sh")
    linked = classes.select("sh", "least").join(roots, "sh", "left").withColumn("root", F.coalesce("root", "sh"))
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    of = linked.join(best, "root").select(F.col("sh").alias("f"), "best")
    keys = prints.select("doc_id", "th", "sh").join(of, F.col("sh") == F.col("f")).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("th").eqNullSafe(F.col("best.th")))
    keys = keys.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
    keys = written(keys.where("not stays or n > 1"), "simhash-keys")
    side = F.broadcast if keys.count() <= broadcast_rows else lambda df: df
    here = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("d_"), F.xxhash64(text_col).alias("t_"))
    same = F.col("d_").eqNullSafe(F.col("d")) & F.col("t_").eqNullSafe(F.col("t"))
    once = here.join(side(keys), same, "left_anti").select("row.*")
    repeated = keys.where("stays")
    if repeated.isEmpty():
        return once
    again = here.join(side(repeated), same, "left_semi").groupBy("d_", "t_").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(again)
