"""File sets: forecast files by date pattern, best estimate over overlapping batches, text formats, sinks."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: strftime tokens from coarse to fine, with the step that lists every name once
STEPS = [("%Y", "year"), ("%m", "month"), ("%d", "day"), ("%j", "day"), ("%H", "hour"), ("%M", "minute"), ("%S", "second")]
GLOBS = {"%Y": "[0-9]" * 4, "%m": "[0-1][0-9]", "%d": "[0-3][0-9]", "%j": "[0-3][0-9][0-9]", "%H": "[0-2][0-9]", "%M": "[0-5][0-9]", "%S": "[0-6][0-9]"}


def frequency(pattern: str) -> str | None:
    """The finest unit of a date pattern; None if it has no date."""
    found = [unit for token, unit in STEPS if token in pattern]
    return found[-1] if found else None


def glob_of(pattern: str) -> str:
    for token, there in GLOBS.items():
        pattern = pattern.replace(token, there)
    return pattern


def dated_names(pattern: str, lo: datetime, hi: datetime) -> list[str]:
    """Names of a date pattern for [lo, hi], sorted, each once."""
    unit, names, at = frequency(pattern), [], lo
    while at <= hi:
        names.append(at.strftime(pattern))
        if unit is None:
            break
        if unit in ("year", "month"):
            months = at.year * 12 + at.month - 1 + (12 if unit == "year" else 1)
            at = datetime(months // 12, months % 12 + 1, 1)
        else:
            at += timedelta(**{unit + "s": 1})
    return sorted(set(names))


def read(spark: SparkSession, paths: str | list[str], kind: str = "parquet", **options) -> DataFrame:
    """A lazy table of one or more files; ``kind`` as for spark.read.format, or a registered reader."""
    if kind in READERS:
        return READERS[kind](spark, paths, **options)
    return spark.read.format(kind).options(**options).load(paths)


def register(kind: str, reader) -> None:
    """Names a reader (spark, paths, **options) -> DataFrame."""
    READERS[kind] = reader


def best_estimate(batches: DataFrame, batch: str, ts: str, by: list[str], offset: Column | None = None) -> DataFrame:
    """Of overlapping batches, in the order of ``batch``, each counts up to the first time of the next (plus ``offset``).

    First times are a row a batch, and are joined back; no series is gathered.
    """
    first = batches.groupBy(*by, batch).agg(F.min(ts).alias("_first"))
    w = W.partitionBy(*by).orderBy(batch)
    until = F.lead("_first").over(w)
    until = first.select(*by, batch, (until + offset if offset is not None else until).alias("_until"))
    joined = batches.join(until, [*by, batch])
    return joined.filter(F.col("_until").isNull() | (F.col(ts) < F.col("_until"))).drop("_until")


def station_table(spark: SparkSession, path: str) -> DataFrame:
    """Fixed width: a name of 29 characters, then latitude, longitude and height."""
    line = F.col("value")
    numbers = F.split(F.trim(F.substring(line, 30, 1000)), r"\s+")
    rows = spark.read.text(path).filter(F.length(F.trim(line)) > 29)
    return rows.select(F.trim(F.substring(line, 1, 29)).alias("name"), *[F.get(numbers, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(("lat", "lon", "z"))])


def xyz(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Text of three numbers a line, by white space or ``sep``; lines that begin with # do not count."""
    numbers = F.split(F.trim("value"), r"\s+" if sep == " " else rf"\s*{sep}\s*")
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(*[F.get(numbers, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")])


def namelist(spark: SparkSession, path: str) -> DataFrame:
    """``&group key = value ... /`` blocks: a row a key. Keys in lower case; quotes around values go."""
    text = spark.read.text(path, wholetext=True).select("value")
    groups = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)&(\w+.*?)\n\s*/"), F.lit(1))).alias("g"))
    lines = groups.select(F.lower(F.regexp_extract("g", r"^(\w+)", 1)).alias("name"), F.explode(F.split("g", r"\n")).alias("line"))
    parts = lines.select("name", F.lower(F.trim(F.regexp_extract("line", r"^\s*(?:&\w+\s+)?(\w+)\s*=", 1))).alias("key"), F.regexp_extract("line", r"=\s*['\"]?(.*?)['\"]?\s*,?\s*(?:!.*)?$", 1).alias("value"))
    return parts.filter("key != ''")


def mean_sea_level(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, inverse: bool = False) -> DataFrame:
    """Stations and their mean sea level, of the same format: name, lat, lon, z; those in (xmin, ymin, xmax, ymax), or
    not in it. Lines without three numbers go."""
    rows = station_table(spark, path).filter("lat is not null and lon is not null and z is not null")
    if box is None:
        return rows
    within = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    return rows.filter(~within if inverse else within)


def casts_csv(spark: SparkSession, path: str, good: str = "0111111") -> DataFrame:
    """Profiles in comma-separated lines of platform, time, lat, lon, depth, temp, sal and flags, after a line of names:
    the lines whose flags are ``good``; a profile is what a platform measured at one time."""
    schema = "platform string, time string, lat double, lon double, depth double, temp double, sal double, qc string"
    rows = spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.filter(F.col("qc") == good).withColumn("time", F.col("time").cast("timestamp_ntz")).drop("qc")


def save_profiles(df: DataFrame, path: str, by: list[str]) -> None:
    """Profiles as one sorted Parquet table, the rows of a profile together."""
    df.repartition(*[F.col(b) for b in by]).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def write_series(df: DataFrame, path: str, ts: str, value: str) -> None:
    """Text lines ``yyyy/MM/dd HH:mm:ss value``."""
    df.select(F.concat_ws(" ", F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), F.format_string("%g", F.col(value)))).write.text(path)


def write_xyz(df: DataFrame, path: str, x: str = "x", y: str = "y", z: str = "z") -> None:
    df.select(F.format_string("%10f %10f %10f", x, y, z)).write.text(path)


def save_grid(grid: DataFrame, path: str, z: str = "z", masked: bool = True, kind: str = "parquet") -> None:
    """Writes a gridded field, rows in order of its cells; without ``masked`` cells of no value are left out."""
    rows = grid if masked else grid.filter(F.col(z).isNotNull())
    rows.repartitionByRange("j", "i").sortWithinPartitions("j", "i").write.format(kind).mode("overwrite").save(path)


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, from their metadata alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return found.agg(F.sum("length")).first()[0] or 0


def find(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, modified, length of the files below a path whose whole path matches a regular expression."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return every.select("path", F.col("modificationTime").alias("modified"), "length").filter(F.col("path").rlike(pattern))


def parse_size(text: str, si: bool = False) -> float:
    """Bytes of '12 Mo', '3kio' and the like: Kio is 1024, Ko 1000 if ``si``, else 1024."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([kmgtp]?)(i?)o?\s*", text.lower())
    if not m:
        raise ValueError(f"no size: {text}")
    return float(m[1]) * (1024 if m[3] or not si else 1000) ** ("kmgtp".index(m[2]) + 1 if m[2] else 0)


def sizes(text: Column, si: bool = False) -> Column:
    """As ``parse_size``, of a column; null where a text is no size."""
    pattern = r"^\s*([0-9.]+)\s*([kmgtp]?)(i?)o?\s*$"
    number, unit, binary = (F.regexp_extract(F.lower(text), pattern, i) for i in (1, 2, 3))
    step = F.when((binary == "") & F.lit(si), 1000.0).otherwise(1024.0)
    power = F.instr(F.lit("kmgtp"), F.when(unit != "", unit))
    return number.try_cast("double") * F.pow(step, F.coalesce(power, F.lit(0)).cast("double"))


def frequencies(pattern: Column) -> Column:
    """As ``frequency``, of a column."""
    out = F.lit(None).cast("string")
    for token, unit in STEPS:
        out = F.when(pattern.contains(token), unit).otherwise(out)
    return out


def globs(pattern: Column) -> Column:
    """As ``glob_of``, of a column."""
    for token, there in GLOBS.items():
        pattern = F.replace(pattern, F.lit(token), F.lit(there))
    return pattern


READERS = {"stations": station_table, "xyz": xyz, "namelist": namelist, "mean_sea_level": mean_sea_level, "casts": casts_csv}
