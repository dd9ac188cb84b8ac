"""From raw documents to packed sequences: five stages, each written and read again as the next one's input.

Defined cases, stage by stage: rows with the same doc_id are different documents; a null doc_id is never held out of training, is smaller
than any other where the largest id keeps a line, and comes last where one document of a group stays; null and empty texts are
scored, are near copies of each other (one stays), are never contaminated, and become one end id. Repeated rows are near copies of each other.
An empty table goes through as one; without labels every document is kept. All stages but the last return the columns of documents, with extra
columns carried along under any names. ``run`` frees what a stage wrote for itself, and its input, once its output is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import classifier, decontam, jaccard, linededup, packing
from kinweave.storage import emptied, fresh_path, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the last one only; n_chars follows the text."""
    return with_chars(linededup.dedup_texts(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("lines", lines), ("near copies", near_copies), ("benchmark", benchmark), ("sequences", sequences)]

#: The classifier and the tokens can't be expressed in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def with_chars(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            emptied(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
