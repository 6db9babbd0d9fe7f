"""Tables written in the shared folder for the time of one computation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.session import cut, delete, shared_dir, ship

__all__ = ["Scratch", "cut", "delete", "shared_dir", "ship"]


class Scratch:
    """Tables in the shared folder; left with `with`, they are deleted, so what is returned from there must be cut before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        self.n += 1
        return f"{self.at}/{self.n}"

    def table(self, df: DataFrame, *partition_by: str) -> DataFrame:
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(at := self.path())
        return self.spark.read.schema(df.schema).parquet(at)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.at)
