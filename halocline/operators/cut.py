"""Cutting the lineage of steps that follow one another.

A written table in the folder that driver and executors share: a lost executor costs the tasks that run, not the steps
before, and no step is computed twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that has none takes a folder of its warehouse, a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


class Steps:
    """Tables of one run under the session's ``spark.checkpoint.dir``. They stay until the folder is cleared, as
    checkpoints do: the result reads the last of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/halocline/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
