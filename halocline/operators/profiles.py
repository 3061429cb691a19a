"""Vertical profiles: rows (by, level, depth, temp, sal), depth negative downward, level 1 at the surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.functions.seawater import GRAVITY, density


def with_density(df: DataFrame, temp: str, sal: str, depth: str | None = None, lat: Column | None = None, out: str = "dens") -> DataFrame:
    return df.withColumn(out, density(F.col(temp), F.col(sal), None if depth is None else -F.col(depth), lat))


def mixed_layer(df: DataFrame, by: list[str], depth: str, value: str, delta: float, out: str = "mld") -> DataFrame:
    """Depth, positive down, where ``value`` first differs from the surface by ``delta`` (a fall if it is negative, a
    rise if positive), on a straight line between levels; the bottom if it nowhere does; null if the surface is null."""
    down = W.partitionBy(*by).orderBy(F.col(depth).desc())
    rows = df.withColumn("_d", F.col(value) - F.first(value).over(down) - delta).withColumns({"_nd": F.lead("_d").over(down), "_nz": F.lead(depth).over(down)})
    over = (F.col("_d") > 0) & (F.col("_nd") <= 0) if delta < 0 else (F.col("_d") < 0) & (F.col("_nd") >= 0)
    at = F.col(depth) + (F.col("_nz") - F.col(depth)) * F.col("_d") / (F.col("_d") - F.col("_nd"))
    surface = F.max_by(value, depth)
    return rows.groupBy(*by).agg((-F.when(surface.isNotNull(), F.coalesce(F.max(F.when(over, at)), F.min(depth)))).alias(out))


def diffusive_layer(df: DataFrame, by: list[str], depth: str, kz: str, least: float = 0.0005, out: str = "mld") -> DataFrame:
    """Depth, positive down, of the shallowest level whose diffusivity is ``least`` or lower; the bottom if none is."""
    low = F.max(F.when(F.col(kz) <= least, F.col(depth)))
    return df.groupBy(*by).agg((-F.coalesce(low, F.min(depth))).alias(out))


def _thickness(df: DataFrame, by: list[str], depth: str) -> DataFrame:
    down = W.partitionBy(*by).orderBy(F.col(depth).desc())
    above, below = F.lag(depth).over(down), F.lead(depth).over(down)
    half = F.coalesce((above - F.col(depth)) / 2, -F.col(depth)) + F.coalesce((F.col(depth) - below) / 2, F.lit(0.0))
    return df.withColumn("_dz", half)


def stratification(df: DataFrame, by: list[str], depth: str, dens: str) -> DataFrame:
    """By profile: dens_min, dens_max, dens_mean (by thickness), height, and two_layer: H (max - mean) / (max - min).

    A level's thickness reaches half way to its neighbours; the first reaches the surface, the last ends there.
    """
    valid = _thickness(df.filter(F.col(dens).isNotNull()), by, depth)
    sums = valid.groupBy(*by).agg(F.min(dens).alias("dens_min"), F.max(dens).alias("dens_max"), (F.sum(F.col(dens) * F.col("_dz")) / F.sum("_dz")).alias("dens_mean"), F.sum("_dz").alias("height"))
    spread = F.nullif(F.col("dens_max") - F.col("dens_min"), F.lit(0.0))
    return sums.withColumn("two_layer", F.col("height") * (F.col("dens_max") - F.col("dens_mean")) / spread)


def energy_deficit(df: DataFrame, by: list[str], depth: str, dens: str, out: str = "ped") -> DataFrame:
    """Potential energy deficit: mean by thickness of g (rho - mean rho) dz."""
    valid = _thickness(df.filter(F.col(dens).isNotNull()), by, depth)
    mean = valid.groupBy(*by).agg((F.sum(F.col(dens) * F.col("_dz")) / F.sum("_dz")).alias("_m"), F.sum("_dz").alias("_h"))
    part = valid.join(mean, by)
    return part.groupBy(*by).agg(F.sum(GRAVITY * (F.col(dens) - F.col("_m")) * F.col("_dz") * F.col("_dz") / F.col("_h")).alias(out))


def quality(df: DataFrame, flags: dict[str, list[int]]) -> DataFrame:
    """Keeps rows whose flag columns are among the good values."""
    for column, good in flags.items():
        df = df.filter(F.col(column).isin(good))
    return df


def aliases(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """New columns from the first of the old ones that has a value; names in either case; null if there is none."""
    have = {c.lower(): c for c in df.columns}
    for new, old in names.items():
        found = [F.col(have[o.lower()]) for o in old if o.lower() in have]
        df = df.withColumn(new, F.coalesce(*found) if found else F.lit(None).cast("double"))
    return df


def histogram(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Rows by calendar unit, with those that have none between the first and the last: start, n."""
    counted = df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    span = counted.agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias("start"))
    return every.join(counted, "start", "left").select("start", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
