"""Sets of dated files as one scan: the names tell which files a time span needs.

Files are listed once, on the driver, which has to list them to read them; those outside the span are never opened. A
file stands from the date in its name until the next file's, so that of overlapping files (forecasts that begin anew)
each gives its own part, the best estimate of every time.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.sources.files import STEPS, glob_of


class Dated(NamedTuple):
    """A file, the date of its name, and that of the next file, None for the last."""

    path: str
    start: datetime
    until: datetime | None


def list_dated(spark: SparkSession, folder: str, pattern: str) -> list[Dated]:
    """The files (or folders) of ``folder`` whose names are dates of ``pattern``, in order of date; of equal dates the
    last by name stands. Names that no date gives are passed over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{glob_of(pattern)}")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    by_date: dict[datetime, str] = {}
    for path in sorted(str(f.getPath()) for f in found or []):
        try:
            by_date[datetime.strptime(path.rpartition("/")[2], pattern)] = path
        except ValueError:
            continue
    dates = sorted(by_date)
    return [Dated(by_date[d], d, n) for d, n in zip(dates, [*dates[1:], None], strict=True)]


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def needed(files: list[Dated], lo: datetime | None, hi: datetime | None, cut: bool) -> list[Dated]:
    """Those that may hold times from ``lo`` to ``hi``, both included: with ``cut`` up to the next file's date, else from
    their own date on, however far."""
    late = [f for f in files if hi is None or f.start <= hi]
    return [f for f in late if lo is None or not cut or f.until is None or f.until > lo]


def scan(spark: SparkSession, folder: str, pattern: str, time: str, lo: datetime | None = None, hi: datetime | None = None, cut: bool = True, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """Rows of the files that ``pattern`` names, with ``time`` from ``lo`` to ``hi``, and their file's date as ``file_date``.

    ``cut``: of overlapping files each counts until the next begins; a file's times before its own date do not count
    then, but for the first file's. Raises FileNotFoundError if no file is needed and no ``schema`` is given to return
    an empty table of. The limits are filters on the scan too, so that groups of rows in the files are passed over.
    """
    if not any(token in pattern for token, _ in STEPS):
        raise ValueError(f"no date in {pattern}")
    every = list_dated(spark, folder, pattern)
    files = needed(every, lo, hi, cut)
    if not files:
        if schema is None:
            raise FileNotFoundError(f"no {pattern} in {folder} for {lo} to {hi}")
        return spark.createDataFrame([], schema).withColumn("file_date", F.lit(None).cast("timestamp_ntz"))
    reader = spark.read.format(kind).options(**options)
    rows = (reader.schema(schema) if schema is not None else reader).load([f.path for f in files])
    t = F.col(time)
    for limit, low in ((lo, True), (hi, False)):
        if limit is not None:
            rows = rows.filter(t >= F.lit(limit) if low else t <= F.lit(limit))
    # a row a file, as many as the driver has listed
    first = every[0].start
    told = [(f.path.rstrip("/").rpartition("/")[2], f.start, None if f.start == first else f.start, f.until) for f in files]
    names = spark.createDataFrame(told, "_name string, file_date timestamp_ntz, _from timestamp_ntz, _until timestamp_ntz")
    # the name is the last part of the path, or that of the folder that a writer has made
    parts = F.split(F.col("_metadata.file_path"), "/")
    last = -2 if is_folder(spark, files[0].path) else -1
    named = rows.withColumn("_name", F.url_decode(F.replace(F.element_at(parts, last), F.lit("+"), F.lit("%2B")))).join(F.broadcast(names), "_name")
    if cut:
        at = t.cast("timestamp_ntz")
        named = named.filter((F.col("_from").isNull() | (at >= F.col("_from"))) & (F.col("_until").isNull() | (at < F.col("_until"))))
    return named.drop("_name", "_from", "_until")
