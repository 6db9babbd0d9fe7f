"""Parquet tables as documents of the search model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.metadata import document_type, extension

_EXTENSIONS = ("md", "txt", "java", "py", "json", "csv", "bin")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """A corpus table (doc_id, text, lang, source) with paths, extensions, sizes, times and types derived from its columns."""
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.pmod("doc_id", F.lit(len(_EXTENSIONS))) + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    rows = documents.select("doc_id", path.alias("path"), "text", F.octet_length("text").cast("long").alias("size_bytes"), (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"), F.lit(0), F.lit(0))).alias("mtime"))
    typed = rows.withColumn("extension", extension(F.col("path")))
    return typed.select("doc_id", "path", "extension", "size_bytes", "mtime", document_type(F.col("path"), F.col("extension")).alias("doc_type"), "text")


def pages_as_files(pages: DataFrame) -> DataFrame:
    """Web pages as documents: the URL is the path, the page's source the text."""
    return pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), F.lit("html").alias("extension"), F.octet_length("html").cast("long").alias("size_bytes"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("mtime"), F.lit("DOC").alias("doc_type"), F.col("html").alias("text"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
