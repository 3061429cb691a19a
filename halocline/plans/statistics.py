"""Queries: statistics, ranks, means over time, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.operators import stats
from halocline.plans.inputs import buoys, pairs, profiles, r6, series, table, with_
from halocline.plans.registry import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)

_NAMES = ["avail", "mean", "std", "min", "max", "mean_y", "std_y", "bias", "rms", "crms", "corr"]
_STATS = """count(*) FILTER (model IS NOT NULL AND obs IS NOT NULL) AS count,
  round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS avail, round(avg(model) FILTER (ok), 6) AS mean, round(stddev_pop(model) FILTER (ok), 6) AS std,
  round(min(model) FILTER (ok), 6) AS min, round(max(model) FILTER (ok), 6) AS max, round(avg(obs) FILTER (ok), 6) AS mean_y, round(stddev_pop(obs) FILTER (ok), 6) AS std_y,
  round(avg(obs - model), 6) AS bias, round(sqrt(avg((obs - model) * (obs - model))), 6) AS rms, round(stddev_pop(obs - model), 6) AS crms, round(corr(obs, model) FILTER (ok), 6) AS corr"""


def _pairs_sql(by: str) -> str:
    return with_("pairs", f"SELECT {by}, {_STATS} FROM (SELECT *, model IS NOT NULL AND obs IS NOT NULL AS ok FROM pairs) GROUP BY {by}")


def _statistics(spark, d, by):
    found = stats.statistics(stats.accumulate(pairs(spark, d), [by], "model", "obs"), [by])
    return found.select(by, "count", *[r6(c).alias(c) for c in _NAMES])


@query(_pairs_sql("cell"))
def accumulate_cells(spark, d):
    """All statistics over time, by cell."""
    return _statistics(spark, d, "cell")


@query(_pairs_sql("month"))
def accumulate_months(spark, d):
    """All statistics over space, by time."""
    return _statistics(spark, d, "month")


@query(_pairs_sql("cell"))
def accumulate_batches(spark, d):
    """The same from sums of two batches, added."""
    p = pairs(spark, d)
    one = stats.accumulate(p.filter(F.month("month") <= 6), ["cell"], "model", "obs")
    two = stats.accumulate(p.filter(F.month("month") > 6), ["cell"], "model", "obs")
    found = stats.statistics(stats.merge(one.unionByName(two), ["cell"]), ["cell"])
    return found.select("cell", "count", *[r6(c).alias(c) for c in _NAMES])


_EDGES = [0.0, 5.0, 10.0, 20.0, 30.0, 50.0]


@query(with_("pairs", "SELECT cell, " + ", ".join(f"count(*) FILTER (model >= {a} AND model < {b}) AS bin{k}" for k, (a, b) in enumerate(zip(_EDGES[:-1], _EDGES[1:], strict=True))) + " FROM pairs GROUP BY cell"))
def accumulate_histogram(spark, d):
    found = stats.accumulate(pairs(spark, d), ["cell"], "model", edges=_EDGES)
    return found.select("cell", *[F.get("hist", F.lit(k)).alias(f"bin{k}") for k in range(len(_EDGES) - 1)])


@query("""SELECT l_orderkey AS cell, sum(CASE WHEN l_quantity < o_totalprice / 8000 THEN 1 ELSE 0 END)::BIGINT AS rank, count(*) AS members
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def ensemble_rank(spark, d):
    members = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    members = members.select(F.col("l_orderkey").alias("cell"), F.col("l_quantity").alias("m"), (F.col("o_totalprice") / 8000).alias("o"))
    return stats.ensemble_rank(members, ["cell"], "m", "o")


@query(with_("pairs", "SELECT cell, round(quantile_cont(obs, 0.05), 6) AS low, round(quantile_cont(obs, 0.95), 6) AS high FROM pairs GROUP BY cell"))
def quantile_range(spark, d):
    found = stats.quantile_range(pairs(spark, d), ["cell"], "obs")
    return found.select("cell", r6("low").alias("low"), r6("high").alias("high"))


@query(with_("pairs", """SELECT cell, count(obs) AS valid, round(100.0 * count(obs) / count(*), 6) AS percent FROM pairs GROUP BY cell"""))
def observation_coverage(spark, d):
    found = stats.coverage(pairs(spark, d), ["cell"], "obs")
    return found.select("cell", "valid", r6("percent").alias("percent"))


@query(with_("profiles", """SELECT profile, CAST(CASE WHEN abs(s) = n THEN sign(s) ELSE 0 END AS INT) AS systematic
  FROM (SELECT profile, sum(sign(sal - (temp + 22.3::DOUBLE))) AS s, count(*) AS n FROM profiles GROUP BY profile)"""))
def systematic_bias(spark, d):
    p = profiles(spark, d).withColumn("model", F.col("temp") + 22.3)
    return stats.systematic_bias(p, ["profile"], "model", "sal")


@query(with_("profiles", """SELECT profile, round(arg_min(x, abs(x)), 6) AS least, round(arg_max(x, abs(x)), 6) AS greatest FROM (SELECT profile, sal - temp AS x FROM profiles) GROUP BY profile"""))
def bias_extrema(spark, d):
    found = stats.bias_extrema(profiles(spark, d), ["profile"], "temp", "sal")
    return found.select("profile", r6("least").alias("least"), r6("greatest").alias("greatest"))


@query(with_("pairs", """SELECT month, round(sum(obs * (1 + cell)) / sum(CASE WHEN obs IS NOT NULL THEN 1 + cell END), 6) AS mean FROM pairs GROUP BY month"""))
def weighted_spatial_mean(spark, d):
    found = stats.weighted_mean(pairs(spark, d), ["month"], "obs", (1 + F.col("cell")).cast("double"))
    return found.select("month", r6("mean").alias("mean"))


def _mean_sql(bucket: str) -> str:
    return f"SELECT event_type AS kind, {bucket} AS t, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"


def _means(spark, d, bucket):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("kind"), bucket.alias("t")).agg(r6(F.avg("value")).alias("mean"))


@query(_mean_sql("date_trunc('hour', ts)"))
def hourly_mean(spark, d):
    return _means(spark, d, F.date_trunc("hour", "ts").cast("timestamp_ntz"))


@query(_mean_sql("date_trunc('day', ts - INTERVAL 12 HOUR) + INTERVAL 12 HOUR"))
def daily_mean_from_noon(spark, d):
    half = F.expr("interval 12 hour")
    return _means(spark, d, F.date_trunc("day", F.col("ts") - half).cast("timestamp_ntz") + half)


@query(_mean_sql("date_trunc('month', ts)"))
def monthly_mean(spark, d):
    return _means(spark, d, F.date_trunc("month", "ts").cast("timestamp_ntz"))


@query("SELECT date_trunc('year', o_orderdate) AS t, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def yearly_mean(spark, d):
    return table(spark, d, "orders").groupBy(F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("t")).agg(r6(F.avg("o_totalprice")).alias("mean"))




def _hours():
    return F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("t")) / 3600.0


_H = "date_diff('second', TIMESTAMP '2024-01-01', t) / 3600.0::DOUBLE"


@query(with_("series", f"SELECT kind, round(regr_slope(v, {_H}), 6) AS slope, round(regr_intercept(v, {_H}), 6) AS intercept FROM series GROUP BY kind"))
def linear_trend(spark, d):
    found = stats.trend(series(spark, d).withColumn("h", _hours()), ["kind"], "h", "v")
    return found.select("kind", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(with_("series", f"""&, line AS (SELECT kind, regr_slope(v, {_H}) AS a, regr_intercept(v, {_H}) AS b FROM series GROUP BY kind)
  SELECT kind, t, round(v - (a * {_H} + b), 6) AS detrended FROM series JOIN line USING (kind)""".replace("&, ", "&")))
def detrended(spark, d):
    found = stats.detrend(series(spark, d).withColumn("h", _hours()), ["kind"], "h", "v")
    return found.select("kind", "t", r6("detrended").alias("detrended"))


@query(with_("series", "SELECT kind, t, round(v - avg(v) OVER (PARTITION BY kind), 6) AS anomaly FROM series"))
def series_anomaly(spark, d):
    return stats.anomaly(series(spark, d), ["kind"], "v").select("kind", "t", r6("anomaly").alias("anomaly"))


@query(with_("buoys", """&s AS (SELECT CAST(((floor((v % 360 + 360 + 11.25) / 22.5)) % 16 + 16) % 16 AS INT) AS sector, CAST(buoy % 4 AS INT) AS region FROM buoys),
  c AS (SELECT region, sector, count(*) AS n FROM s GROUP BY 1, 2)
  SELECT region, sector * 22.5::DOUBLE AS direction FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, sector) AS k FROM c) WHERE k = 1"""))
def dominant_direction(spark, d):
    b = buoys(spark, d).withColumn("region", (F.col("buoy") % 4).cast("int")).withColumn("a", F.col("v") % 360 + 360)
    return stats.dominant_direction(b, ["region"], "a")
