"""Tables written to the folder that driver and executors share.

A written table cuts the lineage: a lost executor costs the tasks that run, not the steps before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets the shuffle files of a query go when it ends; a written table is not shuffled again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds the bytes that a Python worker gets at once; a longer row comes alone.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a local session takes a folder under its warehouse;
    on a cluster, whose machines may not share that, it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Workspace:
    """Written tables of one run of an operator. ``drop`` removes those that no later step reads, ``keep`` all but
    those that the result reads; these stay until ``clear``, as checkpoints do."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/halocline/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with _setting(self.spark, CLEANUP, "true"), _setting(self.spark, BATCH, BATCH_BYTES):
            df.write.option("compression", "zstd").parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables."""
        for name in names:
            path = self._paths.pop(name, None)
            if path:
                _delete(self.spark, path)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        self.drop(*[name for name in self._paths if name not in names])


def clear(spark: SparkSession) -> None:
    """Removes the tables of all runs, of results that are no longer read."""
    _delete(spark, f"{shared_dir(spark)}/halocline")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made from ``names``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"{name}_"
        have.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
