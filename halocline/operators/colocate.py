"""A model's values where and when profiles were taken: the nearest column, times on either side, depths of both.

Nothing is paired off: a column's times, and a time's depths, are put in one sort with those that are asked for, and
running windows look up and down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.functions.seawater import density, pressure
from halocline.operators.points import nearest


def _brackets(df: DataFrame, by: list[str], at: str, here: str, found: Column) -> DataFrame:
    """Adds _lo and _hi: ``found`` of the nearest rows that are ``here`` with ``at`` no greater and no less than a row's."""
    w = W.partitionBy(*by).orderBy(F.col(at), F.col(here).desc())
    up = W.partitionBy(*by).orderBy(F.col(at).desc(), F.col(here).desc())
    found = F.when(F.col(here), found)
    return df.withColumns({"_lo": F.last(found, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_hi": F.last(found, True).over(up.rowsBetween(W.unboundedPreceding, 0))})


def colocate_strata(model: DataFrame, column: str, profiles: DataFrame, profile: str, size: float, time: str = "time", depth: str = "depth", lon: str = "lon", lat: str = "lat",
                    values: tuple[str, ...] = ("temp", "sal"), farthest: float | None = None) -> DataFrame:
    """One row per row of ``profiles`` (profile, lon, lat, time, depth): profile, time, depth, column, distance and the
    model's ``values`` there: of the nearest column on the sphere, linear in depth at the model's times on either side,
    and linear in time between these.

    ``model``: column, lon, lat, time, depth and values, a row a cell; times are numbers. A value is null beyond the
    model's times or depths, where one of the four cells around lacks it, and where the nearest column is more than
    ``farthest`` metres away. A cell's null counts as missing, so that the next one does not stand in for it. Columns do
    not move; of repeated cells the mean counts. ``size``: degrees of the cells in which columns are first sought.
    """
    cells = model.groupBy(F.col(column).alias("_column"), F.col(time).cast("double").alias("_t"), F.col(depth).cast("double").alias("_z")).agg(*[F.avg(v).alias(v) for v in values])
    columns = model.groupBy(column).agg(F.first(lon).alias(lon), F.first(lat).alias(lat))
    asked = profiles.select(F.col(profile).alias("_profile"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col(time).cast("double").alias("_t"), F.col(depth).cast("double").alias("_z"), F.struct(time, depth).alias("_as"))
    asked = asked.withColumn("_place", F.xxhash64("lon", "lat"))
    places = asked.groupBy("_place").agg(F.first("lon").alias(lon), F.first("lat").alias(lat))
    near = nearest(places, "_place", columns, column, size, lon, lat, out="_column")
    if farthest is not None:
        near = near.filter(F.col("distance") <= farthest)
    rows = asked.join(near.select("_place", "_column", "distance"), "_place", "left")
    # the column's times around each time that is asked for
    wanted = rows.filter(F.col("_column").isNotNull()).select("_column", "_t").distinct().withColumn("_here", F.lit(False))
    times = cells.select("_column", "_t").distinct().withColumn("_here", F.lit(True)).unionByName(wanted)
    times = _brackets(times, ["_column"], "_t", "_here", F.col("_t")).filter("not _here").select("_column", "_t", F.col("_lo").alias("_t0"), F.col("_hi").alias("_t1"))
    rows = rows.join(times, ["_column", "_t"], "left")
    # the depths around, at both times
    steps = F.explode(F.array_distinct(F.array("_t0", "_t1"))).alias("_at")
    levels = rows.filter("_t0 is not null and _t1 is not null").select("_column", "_z", steps).distinct()
    both = cells.withColumnRenamed("_t", "_at").withColumn("_here", F.lit(True)).unionByName(levels.withColumn("_here", F.lit(False)), allowMissingColumns=True)
    both = _brackets(both, ["_column", "_at"], "_z", "_here", F.struct("_z", *values)).filter("not _here")
    share = F.when(F.col("_hi._z") > F.col("_lo._z"), (F.col("_z") - F.col("_lo._z")) / (F.col("_hi._z") - F.col("_lo._z"))).otherwise(0.0)
    at_depth = both.select("_column", "_at", "_z", *[(F.col(f"_lo.{v}") + share * (F.col(f"_hi.{v}") - F.col(f"_lo.{v}"))).alias(v) for v in values])
    for end in ("0", "1"):
        part = at_depth.select("_column", F.col("_at").alias(f"_t{end}"), "_z", *[F.col(v).alias(f"_{v}{end}") for v in values])
        rows = rows.join(part, ["_column", f"_t{end}", "_z"], "left")
    share = F.when(F.col("_t1") > F.col("_t0"), (F.col("_t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
    out = [(F.col(f"_{v}0") + share * (F.col(f"_{v}1") - F.col(f"_{v}0"))).alias(v) for v in values]
    return rows.select(F.col("_profile").alias(profile), F.col(f"_as.{time}").alias(time), F.col(f"_as.{depth}").alias(depth), F.col("_column").alias(column), "distance", *out, F.col("lat").alias("_lat")).withColumnRenamed("_lat", lat)


def with_pressure_and_density(found: DataFrame, temp: str = "temp", sal: str = "sal", depth: str = "depth", lat: str = "lat") -> DataFrame:
    """Adds pres (decibars) and dens (kg / m^3) of what ``colocate_strata`` gives; depths are negative downward."""
    z, la = -F.col(depth), F.col(lat)
    return found.withColumns({"pres": pressure(z, la), "dens": density(F.col(temp), F.col(sal), z, la)})
