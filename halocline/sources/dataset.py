"""Datasets: files opened by kind, variables asked for by standard name and selected by axis, or derived from others.

    open_dataset(spark, paths).get("temp", time=(t0, t1, "co"), lon=(-10, 5), level=(-50, 0))

All is lazy: names are resolved on the schema, selections become predicates that reach the scan, and only the columns
asked for are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.functions import names
from halocline.functions.seawater import density, surface_density
from halocline.functions.units import modulus
from halocline.operators import profiles
from halocline.operators.select import between
from halocline.operators.windows import time_step
from halocline.sources import files

AXES = {"time": "time", "level": "depth", "lat": "lat", "lon": "lon"}


class Dataset:
    """A table with named variables. ``keys``: columns besides the axes that tell rows apart (profile, member)."""

    def __init__(self, df: DataFrame, keys: list[str] | None = None):
        self.df, self.keys = df, keys or []

    def axes(self) -> list[str]:
        """Our names of the axes that are there."""
        return [a for a in AXES.values() if names.find(self.df, a)]

    def has(self, name: str) -> bool:
        return names.find(self.df, name) is not None

    def select(self, **limits: tuple) -> Dataset:
        """Rows within limits by time, level, lat and lon: (lo, hi) or (lo, hi, bounds); None is no limit."""
        df = self.df
        for axis, limit in limits.items():
            if limit is not None:
                column = names.find(df, AXES[axis])
                if column is None:
                    raise KeyError(axis)
                df = df.filter(between(F.col(column), *limit))
        return Dataset(df, self.keys)

    def table(self, *variables: str) -> DataFrame:
        """Keys, axes and variables under our names."""
        out = [F.col(k) for k in self.keys]
        for n in (*self.axes(), *variables):
            column = names.find(self.df, n)
            if column is None:
                raise KeyError(n)
            out.append(F.col(column).alias(n))
        return self.df.select(*out)

    def get(self, name: str, **limits: tuple) -> DataFrame:
        """A variable with keys and axes, read or else derived; raises KeyError if it can be neither."""
        chosen = self.select(**limits)
        if chosen.has(name):
            return chosen.table(name)
        if name in DERIVED:
            return DERIVED[name](chosen)
        raise KeyError(name)

    def axis(self, name: str) -> DataFrame:
        """Distinct values of an axis, as time, depth, lat or lon: one column, without nulls."""
        column = names.find(self.df, name)
        if column is None:
            raise KeyError(name)
        return self.df.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct()

    def grid(self) -> DataFrame:
        """Distinct positions: lon, lat."""
        return self.table().select("lon", "lat").distinct()

    def shape(self) -> DataFrame:
        """One row: how many values each axis has."""
        return self.df.agg(*[F.count_distinct(names.find(self.df, a)).alias(a) for a in self.axes()])

    def time_step(self) -> DataFrame:
        """Median step of the time axis in seconds: one row, step."""
        return time_step(self.axis("time").withColumn("_all", F.lit(1)), ["_all"], "time").select("step")

    def variable_names(self) -> list[str]:
        """Our names of the columns that are no axes and no keys, theirs where we have none."""
        axes = {names.find(self.df, a) for a in self.axes()}
        others = [c for c in self.df.columns if c not in axes and c not in self.keys]
        known = {names.find(self.df, n): n for n, spec in names.REGISTRY.items() if not spec.axis}
        return [known.get(c, c) for c in others]

    def columns_by(self) -> list[str]:
        """What tells water columns apart: keys and all axes but the vertical one."""
        return [*self.keys, *[a for a in self.axes() if a != "depth"]]


def _dens(ds: Dataset) -> DataFrame:
    df = ds.table("temp", "sal")
    lat = F.col("lat").cast("double") if "lat" in df.columns else None
    value = density(F.col("temp"), F.col("sal"), -F.col("depth"), lat) if "depth" in df.columns else surface_density(F.col("temp"), F.col("sal"))
    return df.withColumn("dens", value).drop("temp", "sal")


def _potential(ds: Dataset) -> DataFrame:
    df = ds.table("temp", "sal")
    return df.withColumn("dens", surface_density(F.col("temp"), F.col("sal"))).drop("temp", "sal")


def _mld(ds: Dataset) -> DataFrame:
    """By temperature; with salinity by density; by diffusivity if there is nothing else."""
    by = ds.columns_by()
    if ds.has("temp") and ds.has("sal"):
        return profiles.mixed_layer(_potential(ds), by, "depth", "dens", 0.03)
    if ds.has("temp"):
        return profiles.mixed_layer(ds.table("temp"), by, "depth", "temp", -0.2)
    return profiles.diffusive_layer(ds.table("kz"), by, "depth", "kz")


def _ssd(ds: Dataset) -> DataFrame:
    by = ds.columns_by()
    return _potential(ds).groupBy(*by).agg(F.max_by("dens", "depth").alias("ssd"))


def _ped(ds: Dataset) -> DataFrame:
    return profiles.energy_deficit(_potential(ds), ds.columns_by(), "depth", "dens")


def _speed(ds: Dataset) -> DataFrame:
    df = ds.table("u", "v")
    return df.withColumn("speed", modulus(F.col("u"), F.col("v"))).drop("u", "v")


DERIVED: dict[str, Callable[[Dataset], DataFrame]] = {"dens": _dens, "mld": _mld, "ssd": _ssd, "ped": _ped, "speed": _speed}


def open_dataset(spark: SparkSession, paths: str | list[str], kind: str = "parquet", keys: list[str] | None = None, **options) -> Dataset:
    return Dataset(files.read(spark, paths, kind, **options), keys)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Adds to the table at ``path`` the rows whose keys it does not have; makes it if there is none.

    What is added is computed from a table that the same write extends, so the new keys are found before it starts.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)
