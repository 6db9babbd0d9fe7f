"""Small awkward tables that every operator must take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """Columns whose names operators might use for themselves."""
    return df.select("*", *[F.lit(7).alias(c) for c in ("id", "t", "key", "n", "score", "kept", "g", "no", "h1", "line", "root", "a.b", "_left", "y", "tier")])


LONG = " ".join(f"w{k * k % 9973}" for k in range(60_000))

AWKWARD: list[tuple[int | None, str | None]] = [
    (1, None),
    (2, ""),
    (3, "   \n\n \t"),
    (4, "!!! ??? ..."),
    (5, "one"),
    (6, "ünïcödé Wörds 漢字 😀 mixed"),
    (7, LONG),
    (8, "the same line of words in this place\nthe same line of words in this place"),
    (8, "the same line of words in this place\nthe same line of words in this place"),
    (None, "a row without any id at all, but with text"),
    (9, "x" * 50_000),
]


def words(text: str | None) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
