"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, on all overlapping windows of a text.

A word enters as a learned vector of its own hash beside the sum of learned vectors of its character
n-grams, so that a word never seen is read by its letters. All vectors are trained with the network, from
labels of whole documents: a document is as toxic as its worst window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from roadlens.llm.recurrent import Adam, bidirectional, bidirectional_back, init_cell, sigmoid, softmax

_WORD = re.compile(r"[^\W\d_]+")
#: Windows overlap by half, so any phrase of up to 33 words stands whole in one.
WINDOW, STRIDE, HIDDEN = 64, 32, 12
WORD_BUCKETS, GRAM_BUCKETS, DIMS, ORDERS = 1 << 15, 1 << 16, 8, (3, 4, 5)
#: Odd multipliers of the n-gram hash, by position.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of its distinct places' n-grams one word after the other, where each word's begin)."""
    flat = "".join(f"^{w}$" for w in words)
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(c))  # characters to the end of the word, this one included
    of = np.repeat(np.arange(len(words)), sizes)
    grams, owners = [], []
    for n in ORDERS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ c[at + i]) * _MIX[i]
            h ^= h >> np.uint32(15)
        grams.append(h & np.uint32(GRAM_BUCKETS - 1))
        owners.append(of[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words)))  # each word has at least one, ^x$
    mixed = (c ^ np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA77)
    mixed = (mixed ^ (mixed >> np.uint32(13))).astype(np.uint64) * (np.uint64(2) * (np.repeat(sizes, sizes) - left).astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F))
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), ends - sizes) if len(words) else np.empty(0, np.uint64)
    return ((whole ^ (whole >> np.uint64(32))) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), np.concatenate(grams)[order].astype(np.int64), starts


def split_windows(ids: np.ndarray) -> np.ndarray:
    """Overlapping windows (n, WINDOW) that cover all of ``ids``; the last is filled with 0."""
    n = max(1, 1 + -(-(len(ids) - WINDOW) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, dtype=np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


class Toxicity:
    """Word and character vectors -> bidirectional GRU -> attention -> logit of a window; a text's score comes from its largest logit."""

    def __init__(self, seed: int = 5):
        rng, inputs = np.random.default_rng(seed), 2 * DIMS
        self.w = init_cell(rng, "gru", inputs, HIDDEN, "f") | init_cell(rng, "gru", inputs, HIDDEN, "r")
        self.w |= {"att": (rng.standard_normal((2 * HIDDEN, 1)) * 0.1).astype(np.float32), "out": (rng.standard_normal((2 * HIDDEN, 1)) * 0.3).astype(np.float32), "bias": np.zeros(1, np.float32)}
        self.words, self.grams = np.zeros((WORD_BUCKETS, DIMS), np.float32), np.zeros((GRAM_BUCKETS, DIMS), np.float32)
        self.final, self.base = None, 0.0

    def inputs(self, words: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Vectors of words from their buckets, as ``word_buckets`` gives them."""
        if not len(words):
            return np.zeros((0, 2 * DIMS), np.float32)
        n = np.diff(np.r_[starts, len(grams)])
        return np.concatenate([self.words[words], np.add.reduceat(self.grams[grams], starts) / np.sqrt(n)[:, None]], axis=1).astype(np.float32)

    def _step(self, windows: np.ndarray, y: np.ndarray, vocabulary: tuple, adam: Adam, grown: tuple, rng: np.random.Generator, rate: float = 0.15) -> None:
        """One step down the gradient on ``windows`` of numbers of words in ``vocabulary``, from 1. Half of the words are read by their letters only."""
        wb, gb, starts, counts = vocabulary
        used, inverse = np.unique(windows, return_inverse=True)
        inverse = inverse.reshape(windows.shape)
        own = used[used > 0] - 1
        flat = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in own]) if len(own) else np.empty(0, np.int64)
        begins = np.cumsum(np.r_[0, counts[own][:-1]]) if len(own) else np.empty(0, np.int64)
        told = (rng.random(len(own)) < 0.5)[:, None].astype(np.float32)
        x = self.inputs(wb[own], gb[flat], begins) * np.concatenate([np.repeat(told, DIMS, axis=1), np.ones((len(own), DIMS), np.float32)], axis=1)
        if used[0] == 0:
            x = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
        mask, kept = (windows > 0).astype(np.float32), {}
        xs = x[inverse]
        states = bidirectional("gru", self.w, xs, mask, kept)
        att = softmax(np.where(mask > 0, (states @ self.w["att"])[..., 0], -1e9), axis=1)
        pooled = (att[..., None] * states).sum(axis=1)
        d = ((sigmoid(pooled @ self.w["out"][:, 0] + self.w["bias"][0]) - y) / len(y)).astype(np.float32)
        dpool = d[:, None] * self.w["out"][:, 0]
        datt = (states * dpool[:, None, :]).sum(axis=2)
        dscore = att * (datt - (att * datt).sum(axis=1, keepdims=True))
        dstates = att[..., None] * dpool[:, None, :] + dscore[..., None] * self.w["att"][:, 0]
        g, dx = bidirectional_back("gru", self.w, dstates.astype(np.float32), xs, mask, kept)
        g |= {"out": (pooled * d[:, None]).sum(axis=0)[:, None], "bias": d.sum(keepdims=True), "att": (states * dscore[..., None]).sum(axis=(0, 1))[:, None]}
        adam.update(self.w, g)
        order = np.argsort(inverse.ravel(), kind="stable")
        du = np.add.reduceat(dx.reshape(-1, dx.shape[2])[order], np.searchsorted(inverse.ravel()[order], np.arange(len(used))))
        du = du[1:] if used[0] == 0 else du
        per = np.repeat(du[:, DIMS:] / np.sqrt(counts[own])[:, None], counts[own], axis=0)
        for table, acc, at, grad in ((self.words, grown[0], wb[own], du[:, :DIMS] * told), (self.grams, grown[1], gb[flat], per)):
            rows, where = np.unique(at, return_inverse=True)
            total = np.zeros((len(rows), DIMS), np.float32)
            np.add.at(total, where, grad)
            acc[rows] += total * total
            table[rows] -= rate * total / (np.sqrt(acc[rows]) + 1e-4) + 1e-3 * table[rows]

    def fit(self, texts: list[str], labels: np.ndarray, positive: float, *, warm: int = 2, rounds: int = 10, batch: int = 192, left_out: float = 0.2, seed: int = 11) -> Toxicity:
        """Learns from labels of whole texts; ``positive`` is the share of label 1 among all that are labelled.

        The first ``warm`` rounds take windows at random. In the others a toxic text stands by its worst two windows
        as the network sees them, beside the worst windows of all clean texts and some at random.
        Texts left out of training fit the slope and offset of the score.
        """
        self.base = float(positive)
        if len(set(labels.tolist())) < 2:
            return self
        rng, reader = np.random.default_rng(seed), Reader(self)
        split = [split_windows(reader.ids(_WORD.findall(t.lower()))) for t in texts]
        vocabulary = word_buckets(list(reader))
        counts = np.diff(np.r_[vocabulary[2], len(vocabulary[1])])
        held = rng.random(len(texts)) < left_out
        held &= (len(texts) >= 50) & (np.bincount(labels[held], minlength=2).min() > 3)
        windows, of = np.concatenate(split), np.repeat(np.arange(len(texts)), [len(w) for w in split])
        used = windows.any(axis=1)
        windows, of = windows[used], of[used]
        train = np.flatnonzero(~held[of])
        adam, grown = Adam(0.01), (np.zeros_like(self.words), np.zeros_like(self.grams))
        for r in range(warm + rounds):
            if r < warm:
                key = rng.random(len(train))
            else:
                key = -self.logits(np.concatenate([np.zeros((1, 2 * DIMS), np.float32), self.inputs(*vocabulary)]), windows[train])
            order = np.lexsort((key, of[train]))
            first = np.r_[True, np.diff(of[train][order]) > 0]
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            if r < warm:
                chosen = train[order[place < 3]]
            else:
                bad = labels[of[train]] == 1
                worst, clean = train[order[(place < 2) & bad[order]]], train[~bad]
                chosen = np.r_[worst, clean[np.argsort(key[~bad], kind="stable")[: 2 * len(worst)]], rng.permutation(clean)[: len(worst)]]
            chosen = rng.permutation(chosen)
            size = min(batch, max(16, len(chosen) // 12))
            for lo in range(0, len(chosen), size):
                at = chosen[lo : lo + size]
                self._step(windows[at], labels[of[at]].astype(np.float32), (*vocabulary, counts), adam, grown, rng)
        logits = self.logits(np.concatenate([np.zeros((1, 2 * DIMS), np.float32), self.inputs(*vocabulary)]), windows)
        starts = np.flatnonzero(np.r_[True, np.diff(of) > 0])
        top, y, out = np.maximum.reduceat(logits, starts), labels[of[starts]], held[of[starts]]
        if out.any():
            top, y = top[out], y[out]
        features, prior = np.stack([top, np.ones(len(top))], axis=1), np.array([0.5, 0.0])
        weight = np.where(y == 1, positive / max(y.mean(), 1e-9), (1 - positive) / max(1 - y.mean(), 1e-9))
        beta = prior.copy()
        for _ in range(60):  # Newton steps of a logistic regression, at the labels' own proportions
            p = sigmoid(features @ beta)
            h = (features * (weight * p * (1 - p))[:, None]).T @ features + 0.5 * np.eye(2)
            beta = beta - np.clip(np.linalg.solve(h, features.T @ (weight * (p - y)) + 0.5 * (beta - prior)), -1, 1)
        self.final = beta
        return self

    def logits(self, table: np.ndarray, windows: np.ndarray, block: int = 2048) -> np.ndarray:
        """Logit of each window of row numbers of ``table``, the inputs by word; row 0 is filling.

        Both directions run as halves of one batch, and what a word adds to the gates is worked out once a
        word. Filling leaves the state as it is, since its update gate is shut.
        """
        h, w = HIDDEN, self.w
        scale = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)  # sigmoid(x) is (1 + tanh(x / 2)) / 2
        given = np.concatenate([(table @ w[f"{d}x"] + w[f"{d}b"]) * scale for d in "fr"])
        given[[0, len(table)], :h] = 1e4
        into = [w[f"{d}h"] * scale for d in "fr"]
        told = [np.concatenate([w["att"][s], w["out"][s]], axis=1) for s in (slice(0, h), slice(h, 2 * h))]
        out = np.empty(len(windows), np.float32)
        for lo in range(0, len(windows), block):
            own = windows[lo : lo + block].T
            steps, n = own.shape
            state, pre, said = np.zeros((2 * n, h), np.float32), np.empty((2 * n, 3 * h), np.float32), np.empty((2, steps, n, 2), np.float32)
            for s in range(steps):
                a = given[np.concatenate([own[s], own[steps - 1 - s] + len(table)])]
                np.matmul(state[:n], into[0], out=pre[:n])
                np.matmul(state[n:], into[1], out=pre[n:])
                gates = pre[:, : 2 * h] + a[:, : 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new = gates[:, h:] * pre[:, 2 * h :]
                new += a[:, 2 * h :]
                np.tanh(new, out=new)
                state -= new
                state *= gates[:, :h]
                state += new
                np.matmul(state[:n], told[0], out=said[0, s])
                np.matmul(state[n:], told[1], out=said[1, steps - 1 - s])
            both = said[0] + said[1]
            att = softmax(np.where(own > 0, both[..., 0], -1e9), axis=0)
            out[lo : lo + block] = (att * both[..., 1]).sum(axis=0) + w["bias"][0]
        return out

    def scores(self, texts: list[str | None], reader: Reader) -> np.ndarray:
        windows = [split_windows(reader.ids(_WORD.findall(t.lower()))) for t in texts if t]
        out = np.full(len(texts), self.base)
        full = np.array([bool(t) for t in texts])
        if windows and self.final is not None:
            starts = np.cumsum([0] + [len(w) for w in windows[:-1]])
            top = np.maximum.reduceat(self.logits(reader.table(), np.concatenate(windows)), starts)
            worded = np.array([w[0, 0] > 0 for w in windows])
            out[np.flatnonzero(full)[worded]] = sigmoid(top * self.final[0] + self.final[1])[worded]
        return out


class Reader(dict):
    """Numbers of words, from 1, and a growing table of their inputs; started anew when it holds ``most`` words."""

    def __init__(self, model: Toxicity, most: int = 60_000):
        super().__init__()
        self.model, self.most, self.rows = model, most, np.zeros((1, 2 * DIMS), np.float32)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def table(self) -> np.ndarray:
        """Inputs of all words so far; those that came since the last time are worked out together."""
        if len(self.rows) <= len(self):
            fresh = list(self)[len(self.rows) - 1 :]
            self.rows = np.concatenate([self.rows, *(self.model.inputs(*word_buckets(fresh[i : i + 20_000])) for i in range(0, len(fresh), 20_000))])
        return self.rows

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[:1]


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = 600, longest: int = 20_000) -> Toxicity:
    """A model of about ``each`` toxic and twice as many clean documents at most, those of smallest hash, of up to ``longest`` characters.

    Only rows whose crc32 of the id as text leaves another remainder than 2 by 4 are learned from. An id
    that is labelled more than once counts as toxic if any label says so; null ids, labels and texts are left out.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Toxicity()
    rank = (F.xxhash64("doc_id") / F.lit(2.0**64)) + 0.5
    share = F.when(F.col("y") == 1, min(1.0, each / counts.get(1, each))).otherwise(min(1.0, 2 * each / counts.get(0, each)))
    chosen = known.where(rank <= share).limit(4 * each)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text").between(1, longest))
    rows = text.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(6 * each).collect()
    return Toxicity().fit([r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=int), counts.get(1, 0) / sum(counts.values()))


def toxicity_score(model: Toxicity, docs: DataFrame, text: Column) -> Column:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(held.value)
        for texts in batches:
            out, lo, size = [], 0, 0
            values = texts.tolist()
            for i, t in enumerate(values):  # a few MB of text at a time
                size += len(t or "")
                if size > 1_000_000 or i == len(values) - 1:
                    out.append(held.value.scores(values[lo : i + 1], reader))
                    reader.trim()
                    lo, size = i + 1, 0
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return of(text)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 from ``threshold`` on).

    Every window of every text is scored, in one pass without a shuffle. Null texts and those without
    letters get the share of toxic labels as their score, and so does every text if only one class is
    labelled. A null id is not held out. Repeated rows each get a row; other columns are ignored.
    """
    model = train_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        toxicity_score(model, docs, F.col(text_col)).alias("score"),
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
