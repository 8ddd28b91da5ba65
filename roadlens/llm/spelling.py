"""Spelling variants by permuterm rotations of the vocabulary.

A word ends in a terminator and is rotated at each place: ``b$a`` for each cut of a word ``ab``. A
word with one more character ``c`` between ``a`` and ``b`` has the rotation ``b$ac``, so the range
of the prefix ``b$a`` holds, one character further, every word that differs by a replacement there,
and as a whole the one word that lacks the character. All rotations are dealt out and sorted by
that prefix, and each range is scanned once: a word takes from it the number of its neighbours and
the most frequent one. A range has one word a letter of the alphabet, so none grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import LOWER, UPPER, written

TERMINATOR = "$"  # outside the alphabet of words


def vocabulary(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", typo_every: int = 199, least_length: int = 6, least_count: int = 5
) -> DataFrame:
    """(word, n): the words of all texts of at least ``least_length`` code points with ``least_count`` occurrences.

    A run of letters loses a code point where ``typo_every`` divides its checksum with the row's id
    (a null id counts as an empty one; 0: never). Null and empty texts have no words. Counts are added up before they are
    shuffled, so a frequent word has one row a task.
    """
    run, n = F.col("run"), F.char_length("run")
    runs = documents.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % least_length), F.lit(0))).alias("run"),
    )
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if typo_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % n).cast("int")
        cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))
        runs = runs.select(F.when(F.col("h") % typo_every == 0, cut).otherwise(run).alias("run")).where(n >= least_length)
    return runs.groupBy(run.alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, whole, first): each rotation of ``word`` as a whole, and without its last character, which is the one edited.

    ``first`` marks the first of a stretch of equal characters: taking out any other one of it gives
    the same word again.
    """
    marked = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("i"))
    word, i = F.col("word"), F.col("i")
    tail = F.concat(F.substring(word, i + 1, F.char_length(word)), F.lit(TERMINATOR))  # what follows the cut
    whole = F.struct(F.concat(tail, F.substring(word, F.lit(1), i)).alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("first"))
    first = (i == 1) | (F.substring(word, i, F.lit(1)) != F.substring(word, i - 1, F.lit(1)))
    edited = F.struct(F.concat(tail, F.substring(word, F.lit(1), i - 1)).alias("prefix"), F.lit(False).alias("whole"), first.alias("first"))
    both = marked.select("word", "n", F.explode(F.when(i == 0, F.array(whole)).otherwise(F.array(whole, edited))).alias("r"))
    return both.select("r.prefix", "word", "n", "r.whole", "r.first")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words differ by one edit, and the most frequent of them as (n, word), ties to the smaller word.

    ``words`` has one row a word with its count ``n``. A word without neighbours has no row.
    """
    here = Window.partitionBy("prefix")
    ranked = here.orderBy(F.col("n").desc(), "word")
    one = lambda c: F.sum(c.cast("long")).over(here)
    near = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    scanned = rotations(words).select(
        "word",
        F.when(F.lag("word").over(ranked).isNull(), F.lead(near).over(ranked)).otherwise(F.first(near).over(ranked)).alias("best"),
        F.when(F.col("whole"), one(~F.col("whole") & F.col("first"))).otherwise(one(~F.col("whole")) - 1 + F.when(F.col("first"), one(F.col("whole"))).otherwise(0)).alias("near"),
    )
    found = scanned.where(F.col("best").isNotNull()).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the last form that is reached, in rounds that double the reach.

    A form is more frequent than its word by a factor, so chains are short and have no rings.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = written(further, "forms")
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        reached = further.select("word", "root")


def spelling_variants(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    typo_every: int = 199,
    least_length: int = 6,
    least_count: int = 5,
    ratio: int = 5,
) -> DataFrame:
    """Per word: ``word``, ``form`` (the near word of most occurrences, if it has ``ratio`` times as many), ``root``, ``n``, ``n_near``, ``form_n``.

    Words are those of ``vocabulary``. An empty table, or one of null texts, gives no rows; repeated
    rows count again; other columns are ignored. The vocabulary, the scanned ranges and the forms are
    written tables; nothing of them reaches the driver.
    """
    words = written(vocabulary(documents, id_col=id_col, text_col=text_col, typo_every=typo_every, least_length=least_length, least_count=least_count), "words")
    near = words.join(neighbours(words), "word", "left")
    takes = F.col("best.n") >= ratio * F.col("n")
    near = written(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, F.col("best.n")).alias("form_n")),
        "near",
    )
    last = roots(near.where(F.col("form").isNotNull()))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
