"""Prepare the documents for training: five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All stages but the last
return the columns of their input, so that extra columns pass through, whatever their names.

What holds for every stage: a null text counts as the empty one; null ids, languages and sources are values of their own; rows
of equal ids or texts are rows of their own unless a stage says otherwise; texts of any length are looked at whole; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import chunks, leaks, mixing, similarity, toxicity
from fleetlens.llm.tables import documents, fresh
from fleetlens.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language; the classifier learns from ``labels``.

    Empty texts have the score of an empty text.  Without labels of both kinds nothing is toxic.
    """
    model = toxicity.fit_toxicity(docs, documents(spark, sf_dir, "labels"))
    score, = fresh(docs, "toxicity")
    kept = docs.withColumn(score, toxicity.toxicity_score(model))
    return kept.filter(F.col(score) < toxicity.toxic_threshold(model)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose word 5-grams are alike at 0.8 or more: the one of the smallest id.

    Of rows that repeat each other one stays; null ids come last.
    """
    return similarity.one_per_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller ids have too; n_chars follows.

    Of ties, rows of one id, the first in the table keeps the passage.  A null text becomes the empty text.
    """
    cut = chunks.remove_repeats(docs)
    return cut.withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        .otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null and empty items, and an empty benchmark, are held by none."""
    row, other = fresh(docs, "row_id", "row_ref")
    found = leaks.find_leaks(docs, documents(spark, sf_dir, "benchmark")).select(F.col("row").alias(other)).distinct()
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    return placed.join(found, F.col(row) == F.col(other), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words the mix takes of each; those it takes nothing of, as of texts without words, are left out."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("benchmark_leaks", drop_leaks),
    ("source_mix", mix_sources),
]

#: A trained classifier and hash chunks are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table through all stages."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
