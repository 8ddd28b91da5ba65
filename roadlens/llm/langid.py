"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Weights are learned with the follow-the-regularised-leader rule under an elastic-net penalty, which
keeps most of them zero; a temperature fitted on documents left out of training calibrates the
probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from roadlens.llm.recurrent import softmax

BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
_OTHER = re.compile(r"[\W\d_]+")
#: Odd multipliers of the n-gram hash, by position.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def letters(text: str | None) -> str:
    """Lower-cased letters, with one space for whatever lies between; empty if there are none."""
    s = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {s} " if s else ""


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the hashed n-grams of ``letters(...)``."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    parts = []
    for n in ORDERS:
        h = np.full(max(0, len(c) - n + 1), n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * _MIX[i]
            h ^= h >> np.uint32(15)
        parts.append(h & np.uint32(BUCKETS - 1))
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.weights, self.bias, self.temperature = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, value) of unit length: (1 + log tf) * idf."""
        at, n = term_counts(text)
        v = (1 + np.log(n)) * self.idf[at]
        return at, v / max(np.sqrt(v @ v), 1e-12)

    def fit(self, texts: list[str], labels: np.ndarray, *, rounds: int = 4, rate: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, left_out: float = 0.2, seed: int = 9) -> LanguageModel:
        k, rng = len(self.languages), np.random.default_rng(seed)
        rows = [self.features(t) for t in texts]
        order = rng.permutation(len(rows))
        cut = int(len(rows) * (1 - left_out)) if len(rows) >= 10 else len(rows)
        z, n = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((BUCKETS + 1, k), np.float32)

        def leader(at: np.ndarray, penalty: float) -> np.ndarray:
            own = z[at]
            return np.where(np.abs(own) > penalty, -(own - np.sign(own) * penalty) / ((beta + np.sqrt(n[at])) / rate + l2), 0.0)

        for _ in range(rounds):
            for i in rng.permutation(order[:cut]):
                at, v = rows[i]
                at, v = np.append(at, BUCKETS), np.append(v, 1.0)  # the last row is the bias
                w = leader(at, l1)
                p = softmax(v @ w)
                p[labels[i]] -= 1
                g = v[:, None] * p
                grown = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
                z[at] += g - grown / rate * w
                n[at] += g * g
        w = leader(np.arange(BUCKETS + 1), l1)
        self.weights, self.bias = w[:-1].astype(np.float32), w[-1]
        held = order[cut:] if cut < len(rows) else order
        logits, y = np.array([self.logits(*rows[i]) for i in held]), labels[held]
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        s = letters(text)
        if not s or not self.languages:
            return "und", 0.0
        p = softmax(self.logits(*self.features(s)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents by bucket, documents) over all of column ``text``; a task sends one count a bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                if s := letters(t):
                    df[term_counts(s)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, BUCKETS), "n": np.append(df[at], n)})

    rows = texts.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    df[rows["bucket"].to_numpy(dtype=int)] = rows["n"].to_numpy(dtype=np.int64)
    return df[:-1], int(df[-1])


def train_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = 800, most: int = 40_000, longest: int = 20_000) -> LanguageModel:
    """A model of about ``each`` documents of each language, those of smallest hash, of up to ``longest`` characters; document frequencies are of all.

    Where there are so many languages that these would be more than ``most``, each gives fewer, but one at least. Only documents
    whose crc32 of the id as text leaves another remainder than 1 by 3, with a text and a language, are
    learned from. A null id is not held out. Rows that repeat an id and a text count once in the sample.
    Every language is learned; the model takes some 0.8 MB for each.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    d = d.where("text is not null and lang is not null").where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True)))
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return LanguageModel([], np.zeros(BUCKETS))
    df, n = document_frequencies(d.select("text"))
    rank = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5
    quota = max(1, min(each, most // len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, 1.5 * quota / c))]), F.col("lang"))
    fit = d.where(F.length("text").between(1, longest)).withColumn("rank", rank).where(F.col("rank") <= share)
    fit = fit.groupBy("lang", "rank").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))  # over the sample, some ``quota`` rows a language
    taken = fit.withColumn("place", place).where(F.col("place") <= quota).select("lang", "text").orderBy("lang", "text").collect()
    languages = sorted(counts)
    number = {k: i for i, k in enumerate(languages)}
    rows = [(s, number[r["lang"]]) for r in taken if (s := letters(r["text"]))]
    model = LanguageModel(languages, np.log((1 + n) / (1 + df)) + 1)
    return model.fit([s for s, _ in rows], np.array([y for _, y in rows], dtype=int)) if rows else LanguageModel([], np.zeros(BUCKETS))


def language(model: LanguageModel, docs: DataFrame, text: Column) -> Column:
    """Struct (lang_pred, score) of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of(text)


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score.

    Null texts and those without letters are ``und`` with score 0, and so are all where no language is
    known. Two passes over the texts, without a shuffle of them. Repeated rows each get a row; other
    columns are ignored.
    """
    model = train_languages(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    d = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), language(model, docs, F.col(text_col)).alias("p"))
    return d.select("doc_id", "held_out", "p.lang_pred", "p.score")
