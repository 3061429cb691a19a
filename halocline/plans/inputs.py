"""Inputs of the named queries, derived from the driver's tables; SQL holds the same as named subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals: sums differ between engines beyond."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def stations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    lon, lat = (F.col("s_suppkey") * 37) % 360 - 180, (F.col("s_suppkey") * 17) % 160 - 80
    return s.select(F.col("s_suppkey").alias("station"), F.col("s_name").alias("name"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"), F.col("s_acctbal").alias("z"))


def buoys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    lon, lat = (F.col("c_custkey") * 13) % 3600 / 10.0 - 180, (F.col("c_custkey") * 7) % 1600 / 10.0 - 80
    return c.select(F.col("c_custkey").alias("buoy"), lon.alias("lon"), lat.alias("lat"), F.col("c_acctbal").alias("v"))


def field(spark: SparkSession, d: str) -> DataFrame:
    """A grid of 20 x 30 cells: j, i, v."""
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 20).cast("int").alias("j"), (F.col("l_suppkey") % 30).cast("int").alias("i")).agg(F.avg("l_quantity").alias("v"))


def masked(spark: SparkSession, d: str) -> DataFrame:
    return field(spark, d).withColumn("v", F.when((F.col("j") * 7 + F.col("i") * 3) % 11 != 0, F.col("v")))


def series(spark: SparkSession, d: str) -> DataFrame:
    """kind, t (hour), v: the mean in a unit that no rounding ties."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg((F.avg("value") / 7.0137).alias("v"))


def profiles(spark: SparkSession, d: str, together: int | None = None) -> DataFrame:
    """profile, level, depth, temp, sal. ``together``: all rows of a profile in one partition, of about so many rows, so
    that means of levels and what follows by profile are made there, in memory that does not grow with the table."""
    rows = table(spark, d, "lineitem")
    if together:
        rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // together)), "l_orderkey")
    first = rows.groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("s"))
    return first.select(F.col("l_orderkey").alias("profile"), F.col("l_linenumber").alias("level"), (-10.0 * F.col("l_linenumber")).alias("depth"), (F.col("q") / 2).alias("temp"), (30 + F.col("s") * 50).alias("sal"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """cell, month, model, obs; some of either are null."""
    li = table(spark, d, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 50).cast("int").alias("cell"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("model"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice") / 1009).alias("obs"),
    )


def casts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("cast_id"), F.col("o_orderpriority").alias("platform"), (F.col("o_custkey") % 5).cast("int").alias("lat"), (F.col("o_custkey") % 3).cast("int").alias("lon"),
        F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("t"), (F.col("o_orderkey") % 3 == 0).alias("corrupted"),
    )


#: the same, as SQL subqueries
SQL = {
    "stations": "stations AS (SELECT s_suppkey AS station, s_name AS name, CAST((s_suppkey*37) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey*17) % 160 - 80 AS DOUBLE) AS lat, s_acctbal AS z FROM supplier)",
    "buoys": "buoys AS (SELECT c_custkey AS buoy, (c_custkey*13) % 3600 / 10.0::DOUBLE - 180 AS lon, (c_custkey*7) % 1600 / 10.0::DOUBLE - 80 AS lat, c_acctbal AS v FROM customer)",
    "field": "field AS (SELECT CAST(l_partkey % 20 AS INT) AS j, CAST(l_suppkey % 30 AS INT) AS i, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "masked": "masked AS (SELECT j, i, CASE WHEN (j*7 + i*3) % 11 <> 0 THEN v END AS v FROM field)",
    "series": "series AS (SELECT event_type AS kind, date_trunc('hour', ts) AS t, avg(value) / 7.0137::DOUBLE AS v FROM events GROUP BY 1, 2)",
    "profiles": "profiles AS (SELECT l_orderkey AS profile, l_linenumber AS level, -10.0::DOUBLE * l_linenumber AS depth, avg(l_quantity) / 2 AS temp, 30 + avg(l_discount) * 50 AS sal FROM lineitem GROUP BY 1, 2)",
    "pairs": "pairs AS (SELECT CAST(l_suppkey % 50 AS INT) AS cell, date_trunc('month', l_shipdate) AS month, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS model, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice / 1009 END AS obs FROM lineitem)",
    "casts": "casts AS (SELECT o_orderkey AS cast_id, o_orderpriority AS platform, CAST(o_custkey % 5 AS INT) AS lat, CAST(o_custkey % 3 AS INT) AS lon, date_trunc('day', o_orderdate) AS t, o_orderkey % 3 = 0 AS corrupted FROM orders)",
}


def with_(names: str, body: str) -> str:
    """``body`` after WITH and the named inputs."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + (", " + body[1:] if body.startswith("&") else " " + body)
