"""Tables on the way, in the folder that all executors share, so that a lost executor loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


class Steps:
    """Tables of one computation; dropped with their files at the end of the block, but for those that `result` keeps."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.count = spark, f"steps_{uuid.uuid4().hex}", 0

    def __enter__(self) -> Steps:
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared(self.spark)}/{self.name}'")
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP DATABASE {self.name} CASCADE")

    def keep(self, df: DataFrame) -> DataFrame:
        """df computed once, as a table of this block."""
        self.count += 1
        df.write.format("parquet").saveAsTable(f"{self.name}.t{self.count}")
        return self.spark.table(f"{self.name}.t{self.count}")

    def result(self, df: DataFrame) -> DataFrame:
        """df computed once, as files that stay after the block, like those of a checkpoint."""
        path = f"{shared(self.spark)}/result-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
