"""A corpus pipeline over ``documents``: each stage reads what the stage before it has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyst.llm import decontaminate, minhash, mixing, suffixes, toxicity
from panelyst.sources.sinks import materialise, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# Of all stages: a NULL or empty text is a document without words, ids and other columns may be NULL, further columns
# of any name stay as they are, and an empty table gives an empty one.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labels of the others than its held-out fold.

    Each row is judged by its text alone, so equal texts share their fate, rows that repeat stay as often as they
    come, and a document without words gets the score of an empty text.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Of equal ids the smallest hash of the text decides, rows without an id come last. Of rows equal in id and text
    one stays. Documents without words are linked with nothing.
    """
    return minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that stand elsewhere too are cut out everywhere; every document stays.

    Rows that repeat stay, and lose all passages of over 50 words, which stand in the other. A text may become
    empty; ``n_chars``, if there, follows the text.
    """
    cut = suffixes.without_repeats(docs, suffixes.WORDS, words=True)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in cut.columns else cut


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item's shingles go.

    Rows are judged by id and text, so rows that repeat go or stay together; documents and items without words match
    nothing.
    """
    items = materialise(decontaminate.item_sketches(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "items")
    found = decontaminate.leaks(docs, items).select("doc_id", "text_hash").distinct().alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.text_hash"))
    return docs.alias("d").join(found, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of ``copies``, which replaces a column of that name.

    Rows that are equal in all columns become one with all their copies; rows that differ anywhere stay apart.
    Documents without words are taken the whole part of their share. A NULL source is one of its own.
    """
    names = [c for c in docs.columns if c != "copies"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).dropDuplicates().alias("d")
    every = [F.col(f"`{c}`") for c in names]
    taken = mixing.mix(docs, tie=F.xxhash64(*every)).groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"))
    taken = taken.where("copies > 0").alias("t")
    own = [F.col(f"d.`{c}`") for c in names]
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.xxhash64(*own) == F.col("t.tie"))
    return rows.join(taken, same).select(*own, F.col("t.copies").alias("copies"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The stages train models, hash and draw; tests hold them against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
