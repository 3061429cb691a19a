"""Named queries over the driver's tables, with the same arithmetic in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halocline.plans import fields, gridding, more, points, scattered, series, statistics, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for part in (statistics, series, fields, points, gridding, scattered, more, streams):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE
FLAGSHIP = "accumulate_cells"
