"""The corpus pipeline: five stages from raw documents to a mixture for training.

Each stage takes (spark, docs, sf_dir) and returns the documents that it kept, with the columns of
``documents``; the last adds those of the mixture. ``run`` writes each stage's result to the shared
folder and reads it back for the next.

Rows with null or repeated ids, null or empty texts and null columns pass through every stage like any
other, but for what the stages say; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import table, written
from roadlens.llm.decontaminate import decontaminated
from roadlens.llm.mixing import mixed
from roadlens.llm.pii import masked
from roadlens.llm.simhash import deduplicated
from roadlens.llm.toxicity import toxicity_score, train_toxicity

TOXIC_FROM = 0.3
LANGUAGE_SHARES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
BUDGET_SHARE = 0.8
#: Bytes that go to a Python worker at a time, where Spark's own bound is 10,000 rows: as whole texts, tens of MB on either side.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is ``TOXIC_FROM`` or more. Null texts and those without letters score the share of toxic labels; without labels of both classes nothing is learned and all score that share."""
    _small_batches(spark)
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(model, docs, F.col("text")) < TOXIC_FROM)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id, null ids last: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. All texts without words are one group."""
    _small_batches(spark)
    return deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark: 10 words in a row, or a whole item of fewer. Texts without words stay, and so do all where the benchmark is empty."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; ``n_chars`` follows. Every document stays; a null text stays null."""
    _small_batches(spark)
    return masked(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the target shares of languages and the smoothed ones of sources and topics. Texts without words have no tokens and leave; null languages and sources are values of their own."""
    return mixed(docs, targets={"lang": LANGUAGE_SHARES}, budget_share=BUDGET_SHARE).where("kept").drop("kept")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Classifier scores and XXH64 fingerprints cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages kept, with ``n_tokens``, ``weight`` and ``probability`` in the mixture."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
