"""A bank of sounding sets: points under names in one partitioned table, chosen by box, merged by priority.

    bank = Bank(spark, path); bank.add(points, "survey"); bank.select(xmin=-5, xmax=0); bank.merged(["old", "survey"])

The catalogue is read from the table: extents are one aggregation over two columns, whose statistics Parquet keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.operators.points import overlay
from halocline.operators.sections import hull


class Bank:
    """Points x, y, z by ``id`` at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/id={name}")

    def has(self, name: str) -> bool:
        where = self._folder(name)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def add(self, points: DataFrame, name: str, force: bool = False) -> None:
        """Keeps ``points`` (x, y, z) under a name; one that is taken raises ValueError, unless ``force`` replaces it."""
        if self.has(name) and not force:
            raise ValueError(f"{name} is in the bank")
        points.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z")]).write.mode("overwrite").parquet(f"{self.path}/id={name}")

    def remove(self, name: str) -> None:
        where = self._folder(name)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def copy(self, name: str, new: str) -> None:
        self.add(self.load(name), new)

    def table(self) -> DataFrame:
        """id, x, y, z of all sets; a filter on id reads the sets it names alone."""
        return self.spark.read.schema("x double, y double, z double, id string").parquet(self.path).select("id", "x", "y", "z")

    def load(self, name: str) -> DataFrame:
        return self.table().filter(F.col("id") == name).select("x", "y", "z")

    def extents(self) -> DataFrame:
        """id, n, xmin, xmax, ymin, ymax."""
        return self.table().groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))

    def select(self, xmin: float | None = None, xmax: float | None = None, ymin: float | None = None, ymax: float | None = None, margin: float = 0.0) -> DataFrame:
        """id, n and extent of the sets that meet a box, widened by ``margin``; None is no limit."""
        found = self.extents()
        for limit, column, sign in ((xmin, "xmax", -1), (xmax, "xmin", 1), (ymin, "ymax", -1), (ymax, "ymin", 1)):
            if limit is not None:
                found = found.filter(F.col(column) >= limit - margin if sign < 0 else F.col(column) <= limit + margin)
        return found

    def merged(self, names: list[str], opaque: list[str] | None = None) -> DataFrame:
        """Points of the named sets, bottom to top; an ``opaque`` set removes what lies in its hull below it. A hull is
        a few corners, and is read before."""
        hulls = []
        for name in names:
            ring = hull(self.load(name)).orderBy("n").collect() if name in (opaque or []) else []
            hulls.append([(r["x"], r["y"]) for r in ring] or None)
        return overlay([self.load(n).withColumn("id", F.lit(n)) for n in names], hulls)
