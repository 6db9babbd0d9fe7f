"""Corpus pipeline: documents to packed training windows.

STAGES are applied in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next stage's documents. All but the last return the columns of documents (extra columns pass through). NULLs, empty texts
and tables, ties, repeated rows and extra columns have the results that each operator's docstring defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, linededup, neardup, packing, quality
from inkwell.llm.common import delete, shared_dir
from inkwell.llm.queries import vocabulary


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length(F.col("text")).cast(docs.schema["n_chars"].dataType))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of the documents table, does not reject.

    A text that is NULL or without words is classified by its structure and metadata like any other.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or an earlier line, already has; documents left without a word go."""
    return _sized(linededup.dedup_lines(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that nearly equal one of a lesser id; documents with a NULL id stay."""
    gone = neardup.near_duplicates(docs).select(F.col("doc_id").alias("__ink_id"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__ink_id"], "left_anti")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark items share, each cut where it is; documents left without a word go."""
    return _sized(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: tokens, the boundaries of the documents in them, tier and step."""
    return packing.pack_documents(docs, vocabulary=vocabulary(spark))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", fresh_lines),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

#: The classifier and the packing are not expressible in SQL; tests/llm hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; every other stage's result is written in the shared folder and reread.

    A stage's table goes once the next one is written. The last stage checkpoints what it reads before it returns, so nothing is left.
    """
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                delete(spark, f"{at}/{k - 1}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        delete(spark, at)
