"""Standard names of variables and axes: a registry, how a column is found by it, and what it says of a column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions.labels import base_name


@dataclass(frozen=True)
class Spec:
    """ids: names in files, the first is ours; standard: standard names; axis: t, z, y, x or '' for variables."""

    ids: tuple[str, ...]
    standard: tuple[str, ...] = ()
    units: str = ""
    long_name: str = ""
    axis: str = ""
    extra: dict = field(default_factory=dict)


# Names of the climate and forecast conventions.
REGISTRY: dict[str, Spec] = {
    "time": Spec(("time", "t"), ("time",), "", "Time", "t"),
    "depth": Spec(("depth", "dep", "z", "lev", "level"), ("depth", "altitude", "ocean_sigma_coordinate"), "m", "Depth", "z"),
    "lat": Spec(("lat", "latitude", "y", "nav_lat"), ("latitude",), "degrees_north", "Latitude", "y"),
    "lon": Spec(("lon", "longitude", "x", "nav_lon"), ("longitude",), "degrees_east", "Longitude", "x"),
    "temp": Spec(("temp", "temperature", "tem", "votemper"), ("sea_water_temperature", "sea_water_potential_temperature"), "degC", "Temperature"),
    "sal": Spec(("sal", "salinity", "psal", "vosaline"), ("sea_water_salinity",), "psu", "Salinity"),
    "sst": Spec(("sst",), ("sea_surface_temperature",), "degC", "Sea surface temperature"),
    "ssh": Spec(("ssh", "xe", "zeta", "sossheig"), ("sea_surface_height_above_sea_level", "sea_surface_height_above_geoid"), "m", "Sea surface height"),
    "u": Spec(("u", "uz", "vozocrtx"), ("sea_water_x_velocity", "eastward_sea_water_velocity"), "m s-1", "Sea water velocity along X"),
    "v": Spec(("v", "vz", "vomecrty"), ("sea_water_y_velocity", "northward_sea_water_velocity"), "m s-1", "Sea water velocity along Y"),
    "dens": Spec(("dens", "density"), ("sea_water_density",), "kg m-3", "Density"),
    "pres": Spec(("pres", "pressure"), ("sea_water_pressure",), "dbar", "Pressure"),
    "mld": Spec(("mld",), ("mixed_layer_depth",), "m", "Mixed layer depth"),
    "bathy": Spec(("bathy", "h", "h0"), ("model_sea_floor_depth_below_sea_level", "sea_floor_depth"), "m", "Bathymetry"),
    "kz": Spec(("kz",), ("average_ocean_vertical_tracer_diffusivity",), "m2 s-1", "Vertical diffusivity"),
    "wind_u": Spec(("u10m", "wind_u"), ("eastward_wind", "x_wind"), "m s-1", "Wind along X"),
    "wind_v": Spec(("v10m", "wind_v"), ("northward_wind", "y_wind"), "m s-1", "Wind along Y"),
}


def register(name: str, spec: Spec) -> None:
    REGISTRY[name] = spec


def without_location(name: str) -> str:
    return re.sub(r"(_at_[tuvwf]_location|_[tuvwf])$", "", name)


def matches(column: str, metadata: dict, name: str) -> bool:
    """By standard name first, then by id, then by long name; case does not count, nor does the place on a grid.

    A name that is not registered is matched as it is.
    """
    spec = REGISTRY.get(name, Spec((name,)))
    standard = str(metadata.get("standard_name", "")).lower()
    if standard:
        return without_location(standard) in spec.standard
    ids = [i.lower() for i in spec.ids]
    if column.lower() in ids or without_location(column.lower()) in ids:
        return True
    return bool(spec.long_name) and str(metadata.get("long_name", "")).lower() == spec.long_name.lower()


def matching(df: DataFrame, column: str, wanted: str, out: str = "matches") -> DataFrame:
    """Adds whether the name in ``column`` is one by which the variable in ``wanted`` goes, by its id or standard name,
    whatever the case and the place on a grid. A name that is not registered is matched as it is."""
    rows = [(k, i.lower()) for k, spec in REGISTRY.items() for i in dict.fromkeys([*spec.ids, *spec.standard])]
    known = F.broadcast(df.sparkSession.createDataFrame(rows, "_wanted string, _id string").distinct())  # the registry
    told = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in REGISTRY], "_told string"))
    joined = df.withColumns({"_name": F.lower(F.col(column)), "_base": base_name(F.lower(F.col(column)))})
    joined = joined.join(known, (F.col("_wanted") == F.col(wanted)) & (F.col("_id") == F.col("_name")), "left").withColumn("_own", F.col("_id").isNotNull()).drop("_wanted", "_id")
    joined = joined.join(known, (F.col("_wanted") == F.col(wanted)) & (F.col("_id") == F.col("_base")), "left").withColumn("_placed", F.col("_id").isNotNull()).drop("_wanted", "_id")
    joined = joined.join(told, F.col("_told") == F.col(wanted), "left")
    same = (F.col("_name") == F.lower(F.col(wanted))) | (F.col("_base") == F.lower(F.col(wanted)))
    return joined.withColumn(out, F.when(F.col("_told").isNull(), same).otherwise(F.col("_own") | F.col("_placed"))).drop("_name", "_base", "_own", "_placed", "_told")


def find(df: DataFrame, name: str) -> str | None:
    """The column that is the named variable or axis, or None. One that says so by standard name comes first."""
    found = [f for f in df.schema.fields if matches(f.name, f.metadata or {}, name)]
    found.sort(key=lambda f: "standard_name" not in (f.metadata or {}))
    return found[0].name if found else None


def get(df: DataFrame, name: str, *axes: str) -> DataFrame:
    """The named variable and axes under our names; raises KeyError for what is not there."""
    out = []
    for n in (*axes, name):
        column = find(df, n)
        if column is None:
            raise KeyError(n)
        out.append(df[column].alias(n))
    return df.select(*out)


def format_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """Renames a column to our name and says in its metadata what it is."""
    spec = REGISTRY[name]
    said = {k: v for k, v in {"standard_name": (spec.standard or ("",))[0], "units": spec.units, "long_name": spec.long_name, "axis": spec.axis.upper()}.items() if v}
    return df.withColumnRenamed(column, name).withMetadata(name, said)


def axis_type(df: DataFrame, column: str) -> str:
    """t, z, y, x, or - for what is no axis."""
    metadata = df.schema[column].metadata or {}
    if metadata.get("axis"):
        return str(metadata["axis"]).lower()
    return next((s.axis for n, s in REGISTRY.items() if s.axis and matches(column, metadata, n)), "-")


def order(df: DataFrame) -> str:
    """Axis types of the columns that are axes, in their order."""
    return "".join(a for a in (axis_type(df, c) for c in df.columns) if a != "-")


def copy_metadata(df: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withMetadata(c, source.schema[c].metadata or {})
    return df
