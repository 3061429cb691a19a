"""Queries: splines, datasets by standard name, text formats, the bank of soundings, shapes, ranks and scalar helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions import labels, maps, names, seawater, times
from halocline.operators import colocate, kriging, points, profiles as prof, sections, select, splines, stats
from halocline.operators.cut import shared_folder
from halocline.plans import fields
from halocline.plans.inputs import buoys, field, masked, profiles, r6, series, stations, table, with_
from halocline.plans.registry import register
from halocline.sources import dated, files
from halocline.sources.bank import Bank
from halocline.sources.dataset import Dataset, append_missing, open_dataset

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/halocline/{name}-{uuid.uuid4().hex}"


# splines: a cubic of time is met exactly

_CUBIC = "pow((x - 300) / 100, 3) - (x - 300) / 50"
_T = "date_diff('second', TIMESTAMP '2024-01-01', t) / 3600.0::DOUBLE"


def _cubic(x):
    u = (x - 300) / 100
    return u * u * u - 2 * u


def _hours(spark, d) -> DataFrame:
    x = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("t")) / 3600.0
    return series(spark, d).select("kind", x.alias("x")).withColumn("v", _cubic(F.col("x")))


@query(with_("series", f"&h AS (SELECT kind, {_T} AS x FROM series), e AS (SELECT kind, min(x) AS a, max(x) AS b FROM h GROUP BY 1), g AS (SELECT kind, a + k * 0.25::DOUBLE AS x, b FROM e, LATERAL (SELECT unnest(range(0, CAST((b - a) * 4 AS BIGINT) + 9)) AS k) u) SELECT kind, round(x, 6) AS x, CASE WHEN x <= b THEN round({_CUBIC}, 4) END AS value FROM g"))
def spline_of_series(spark, d):
    src = _hours(spark, d)
    ends = src.groupBy("kind").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("b") - F.col("a")) * 4).cast("long") + 8))
    dst = ends.withColumn("k", k).select("kind", (F.col("a") + F.col("k") * 0.25).alias("x"))
    return splines.spline(src, dst, ["kind"], "x", "v").select("kind", r6("x").alias("x"), F.round("value", 4).alias("value"))


@query(with_("series", f"&h AS (SELECT kind, {_T} AS x FROM series), e AS (SELECT kind, min(x) AS a, max(x) AS b FROM h GROUP BY 1) SELECT kind, x, CASE WHEN x % 5 <> 2 OR (x > a AND x < b) THEN round({_CUBIC}, 4) END AS filled FROM h JOIN e USING (kind) WHERE x <> a AND x <> b"))
def spline_filled(spark, d):
    """A fifth of the cells are taken away, and come back."""
    h = _hours(spark, d)
    ends = h.groupBy("kind").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    inner = h.join(ends, "kind")
    holed = inner.withColumn("v", F.when((F.col("x") % 5 != 2) | F.col("x").isin(F.col("a"), F.col("b")), F.col("v")))
    filled = splines.fill_spline(holed, ["kind"], "x", "v").filter("x != a and x != b")
    return filled.select("kind", "x", F.round("filled", 4).alias("filled"))


@query(with_("series", """&a AS (SELECT kind, t, v - avg(v) OVER (PARTITION BY kind) AS v FROM series), s AS (SELECT *, CASE WHEN v >= 0 THEN 1 ELSE -1 END AS sign FROM a),
  n AS (SELECT *, CASE WHEN sign <> lag(sign) OVER (PARTITION BY kind ORDER BY t) THEN 1 ELSE 0 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY kind ORDER BY t) AS run FROM n),
  k AS (SELECT *, row_number() OVER (PARTITION BY kind, run ORDER BY t) AS i, count(*) OVER (PARTITION BY kind, run) AS n, row_number() OVER (PARTITION BY kind, run ORDER BY v * sign DESC, t DESC) AS best, lag(v) OVER w AS b, lead(v) OVER w AS f FROM r WINDOW w AS (PARTITION BY kind, run ORDER BY t)),
  e AS (SELECT kind, run, sign, t, v, n, CASE WHEN (b > f AND i > 2) OR i = n - 1 THEN i - 2 ELSE i - 1 END AS first FROM k WHERE best = 1 AND i > 1 AND i < n),
  p AS (SELECT e.kind, e.run, e.sign, e.t, e.v, e.n, min(k.t) AS t0, list(k.v ORDER BY k.i) AS y, list(date_diff('second', TIMESTAMP '2024-01-01', k.t) / 60.0::DOUBLE ORDER BY k.i) AS x FROM e JOIN k ON k.kind = e.kind AND k.run = e.run AND k.i BETWEEN e.first AND e.first + 3 GROUP BY ALL),
  m AS (SELECT *, unnest(range(0, CAST(round(x[4] - x[1]) AS BIGINT) + 1)) AS m FROM p WHERE n >= 4),
  g AS (SELECT *, CASE WHEN m <= x[2] - x[1] THEN 1 WHEN m <= x[3] - x[1] THEN 2 ELSE 3 END AS q FROM m),
  c AS (SELECT *, (m - (x[q] - x[1])) / (x[q + 1] - x[q]) AS u, CASE WHEN q = 1 THEN 2 * y[1] - y[2] ELSE y[q - 1] END AS y_, CASE WHEN q = 3 THEN 2 * y[4] - y[3] ELSE y[q + 2] END AS z FROM g),
  h AS (SELECT *, (2*u*u*u - 3*u*u + 1) * y[q] + (u*u*u - 2*u*u + u) * (y[q + 1] - y_) / 2 + (3*u*u - 2*u*u*u) * y[q + 1] + (u*u*u - u*u) * (z - y[q]) / 2 AS h FROM c),
  top AS (SELECT kind, run, max(h * sign) AS top FROM h GROUP BY 1, 2)
  SELECT kind, round(h, 4) AS value, sign FROM (SELECT h.kind, top.top * any_value(h.sign) AS h, any_value(h.sign) AS sign FROM h JOIN top USING (kind, run) GROUP BY h.kind, h.run, top.top) UNION ALL SELECT kind, round(v, 4), sign FROM e WHERE n < 4"""))
def refined_high_and_low_water(spark, d):
    """Heights; the minute may differ where two are equally high."""
    a = stats.anomaly(series(spark, d), ["kind"], "v")
    return splines.refined_extrema(a, ["kind"], "t", "anomaly").select("kind", F.round("value", 4).alias("value"), "sign")


# ranks, ensembles, probabilities

_MEMBERS = "m AS (SELECT l_orderkey AS cell, l_quantity AS m, o_totalprice / 8017 AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _members(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("l_orderkey").alias("cell"), F.col("l_quantity").alias("m"), (F.col("o_totalprice") / 8017).alias("o"))


@query(f"WITH {_MEMBERS}, r AS (SELECT cell, sum(CASE WHEN m < o THEN 1 ELSE 0 END) AS rank FROM m GROUP BY 1) SELECT k AS rank, count(r.cell) AS n FROM range(8) q(k) LEFT JOIN r ON rank = k GROUP BY 1")
def rank_histogram(spark, d):
    return stats.rank_histogram(stats.ensemble_rank(_members(spark, d), ["cell"], "m", "o"), "rank", 7)


@query(f"WITH {_MEMBERS}, b AS (SELECT cell, min(m - o) AS lo, max(m - o) AS hi, sum(CASE WHEN m < o THEN 1 ELSE 0 END)::BIGINT AS rank FROM m GROUP BY 1) SELECT cell, rank, round(CASE WHEN hi < 0 THEN hi WHEN lo > 0 THEN lo END, 3) AS nrz FROM b")
def not_recovered(spark, d):
    return stats.not_recovered(_members(spark, d), ["cell"], "m", "o").select("cell", "rank", F.round("nrz", 3).alias("nrz"))


@query("""SELECT c_custkey AS id, round(CASE WHEN c_custkey % 2 = 0 THEN 200 / pi() * atan(r / sqrt(1 - r * r)) ELSE 100 * t / sqrt(2 + t * t) END, 3) AS probability
  FROM (SELECT c_custkey, (c_custkey % 19) / 20.0::DOUBLE AS r, ((c_custkey % 19) / 20.0::DOUBLE) * sqrt(2 / (1 - pow((c_custkey % 19) / 20.0::DOUBLE, 2))) AS t FROM customer)""")
def correlation_probability(spark, d):
    """Of five values (one degree of freedom) and of six (two), where Student's integral is closed."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 19) / 20.0).alias("r"), (F.col("c_custkey") % 2 + 5).alias("n"))
    return stats.correlation_probability(c, "r", "n").select("id", F.round("probability", 3).alias("probability"))


@query(with_("series", "SELECT kind, t, round(2 / pi() * atan(v / s), 6) AS normal FROM (SELECT kind, t, v, stddev_pop(v) OVER (PARTITION BY kind) AS s FROM series)"))
def arctan_normal(spark, d):
    return stats.arctan_normal(series(spark, d), ["kind"], "v").select("kind", "t", r6("normal").alias("normal"))


# spectra and hulls

_DFT = """v AS (SELECT j, i, v - avg(v) OVER () AS v, count(*) OVER () AS n FROM field), f AS (SELECT kj, ki, sum(v * cos(2 * pi() * (kj * j / 20.0::DOUBLE + ki * i / 30.0::DOUBLE))) AS re, sum(v * sin(2 * pi() * (kj * j / 20.0::DOUBLE + ki * i / 30.0::DOUBLE))) AS im
  FROM v, range(20) a(kj), range(30) b(ki) GROUP BY 1, 2), r AS (SELECT (re * re + im * im) / 360000 AS p, CAST(round_even(sqrt(pow(CASE WHEN ki * 2 < 30 THEN ki ELSE ki - 30 END / 360.0::DOUBLE, 2) + pow(CASE WHEN kj * 2 < 20 THEN kj ELSE kj - 20 END / 160.0::DOUBLE, 2)) * 360, 0) AS INT) AS ring FROM f)"""


def _whole_field(spark, d):
    """The field with 0 where it has no cell."""
    cells = spark.range(600).select(F.floor(F.col("id") / 30).cast("int").alias("j"), (F.col("id") % 30).cast("int").alias("i"))
    return cells.join(field(spark, d), ["j", "i"], "left").withColumns({"v": F.coalesce("v", F.lit(0.0)), "level": F.lit(0)})


_WHOLE = "whole AS (SELECT CAST(a AS INT) AS j, CAST(b AS INT) AS i, coalesce(v, 0) AS v FROM range(20) x(a), range(30) y(b) LEFT JOIN field ON j = a AND i = b)"


@query(with_("field", f"&{_WHOLE}, {_DFT.replace('FROM field)', 'FROM whole)')}, g AS (SELECT ring, sum(p) AS p FROM r GROUP BY 1) SELECT 0 AS level, round(k / 360.0::DOUBLE, 6) AS k, round(coalesce(p, 0), 6) AS power FROM range(100) q(k) LEFT JOIN g ON ring = k WHERE k <= (SELECT max(ring) FROM g)"))
def ring_spectrum(spark, d):
    found = sections.spectrum(_whole_field(spark, d), ["level"], "v", 12.0, 8.0)
    return found.select("level", r6("k").alias("k"), r6("power").alias("power"))


@query(with_("field", f"&{_WHOLE}, {_DFT.replace('FROM field)', 'FROM whole)')}, g AS (SELECT ring, sum(p) AS p FROM r GROUP BY 1) SELECT 0 AS level, round(k / 360.0::DOUBLE, 6) AS k, round(5 * coalesce(p, 0), 6) AS power FROM range(100) q(k) LEFT JOIN g ON ring = k WHERE k <= (SELECT max(ring) FROM g)"))
def summed_spectrum(spark, d):
    f = _whole_field(spark, d)
    found = sections.summed_spectrum(f, f.withColumn("v", 2 * F.col("v")), ["level"], "v", 12.0, 8.0)
    return found.select("level", r6("k").alias("k"), r6("power").alias("power"))


@query(with_("field", "SELECT j AS kj, i AS ki, round(kx, 9) AS kx, round(ky, 9) AS ky, round(sqrt(kx * kx + ky * ky), 9) AS k FROM (SELECT *, CASE WHEN i * 2 < 30 THEN i ELSE i - 30 END * 2 * pi() / 360 AS kx, CASE WHEN j * 2 < 20 THEN j ELSE j - 20 END * 2 * pi() / 160 AS ky FROM field)"))
def wavenumbers(spark, d):
    """Of the field's cells, taken as those of its transform."""
    w = sections.wavenumbers(spark, 30, 20, 12.0, 8.0).join(field(spark, d).select(F.col("j").alias("kj"), F.col("i").alias("ki")), ["kj", "ki"])
    return w.select("kj", "ki", *[(F.round(c, 9) + 0.0).alias(c) for c in ("kx", "ky", "k")])


_ANGLE = "(CASE WHEN atan2(q.y - p.y, q.x - p.x) < -pi() / 2 - 1e-9 THEN atan2(q.y - p.y, q.x - p.x) + 2 * pi() ELSE atan2(q.y - p.y, q.x - p.x) END)"


@query(f"""WITH RECURSIVE b AS (SELECT (c_custkey*13) % 3600 / 10.0::DOUBLE - 180 + sin(c_custkey * 1.7::DOUBLE) AS x, (c_custkey*7) % 1600 / 10.0::DOUBLE - 80 + cos(c_custkey * 2.3::DOUBLE) AS y FROM customer),
  w(x, y, a) AS (SELECT arg_min(x, x), arg_min(y, x), -pi() / 2 - 1e-9 FROM b
    UNION ALL SELECT n.x, n.y, n.a FROM (SELECT arg_min(q.x, {_ANGLE}) AS x, arg_min(q.y, {_ANGLE}) AS y, min({_ANGLE}) AS a FROM w p, b q WHERE (q.x <> p.x OR q.y <> p.y) AND {_ANGLE} > p.a) n WHERE n.x IS NOT NULL)
  SELECT DISTINCT round(x, 6) AS x, round(y, 6) AS y FROM w""")
def hull_of_buoys(spark, d):
    """From corner to corner by the least turn; no three of these points are on a line."""
    k = F.col("buoy")
    moved = buoys(spark, d).select((F.col("lon") + F.sin(k * 1.7)).alias("x"), (F.col("lat") + F.cos(k * 2.3)).alias("y"))
    return sections.hull(moved).select(r6("x").alias("x"), r6("y").alias("y"))


# datasets: columns found by standard name

def _dataset(spark, d) -> Dataset:
    p = profiles(spark, d).withColumn("stamp", F.timestamp_add("DAY", (F.col("profile") % 9).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    p = p.withColumns({"nav_lon": (F.col("profile") % 40 - 20).cast("double"), "nav_lat": (F.col("profile") % 25 + 30).cast("double"), "vozocrtx": F.col("temp") / 30, "vomecrty": F.col("sal") / 40})
    p = p.withColumnsRenamed({"temp": "votemper", "sal": "measured_salt", "depth": "lev"})
    p = p.withMetadata("measured_salt", {"standard_name": "sea_water_salinity"}).withMetadata("stamp", {"standard_name": "time"})
    return Dataset(p.drop("level"), ["profile"])


_DS = "ds AS (SELECT profile, level, depth, temp, sal, TIMESTAMP '2024-01-01' + to_days(CAST(profile % 9 AS INT)) AS time, CAST(profile % 40 - 20 AS DOUBLE) AS lon, CAST(profile % 25 + 30 AS DOUBLE) AS lat FROM profiles)"


@query(with_("profiles", f"&{_DS} SELECT profile, time, depth, lat, lon, round(temp, 6) AS temp FROM ds WHERE depth BETWEEN -30 AND -10 AND lon >= -10 AND lon < 5 AND time >= TIMESTAMP '2024-01-03'"))
def dataset_variable(spark, d):
    found = _dataset(spark, d).get("temp", level=(-30.0, -10.0), lon=(-10.0, 5.0, "co"), time=(F.lit("2024-01-03").cast("timestamp_ntz"), None))
    return found.withColumn("temp", r6("temp"))


@query(with_("profiles", f"&{_DS} SELECT profile, time, depth, lat, lon, round(sal, 6) AS sal FROM ds"))
def dataset_by_standard_name(spark, d):
    return _dataset(spark, d).get("sal").withColumn("sal", r6("sal"))


@query(with_("profiles", f"&{_DS} SELECT profile, time, depth, lat, lon, round(sqrt(pow(temp / 30, 2) + pow(sal / 40, 2)), 6) AS speed FROM ds"))
def dataset_derived(spark, d):
    """What the file does not have is made of what it has."""
    return _dataset(spark, d).get("speed").withColumn("speed", r6("speed"))


@query(with_("profiles", f"&{_DS} SELECT profile, time, lat, lon, round(arg_max({fields._RHO0}, depth), 6) AS ssd FROM ds GROUP BY ALL"))
def dataset_surface_density(spark, d):
    """Potential density of each column's uppermost level."""
    return _dataset(spark, d).get("ssd").withColumn("ssd", r6("ssd"))


for _name, _type in (("time", "TIMESTAMP"), ("depth", "DOUBLE"), ("lat", "DOUBLE"), ("lon", "DOUBLE")):
    QUERIES[f"dataset_{_name}_axis"] = lambda spark, d, n=_name: _dataset(spark, d).axis(n)
    ORACLE[f"dataset_{_name}_axis"] = with_("profiles", f"&{_DS} SELECT DISTINCT {_name} FROM ds")


@query(with_("profiles", f"&{_DS} SELECT DISTINCT lon, lat FROM ds"))
def dataset_grid(spark, d):
    return _dataset(spark, d).grid()


@query(with_("profiles", f"&{_DS} SELECT count(DISTINCT time) AS time, count(DISTINCT depth) AS depth, count(DISTINCT lat) AS lat, count(DISTINCT lon) AS lon FROM ds"))
def dataset_shape(spark, d):
    return _dataset(spark, d).shape()


@query("SELECT 86400.0::DOUBLE AS step")
def dataset_time_step(spark, d):
    return _dataset(spark, d).time_step()


@query("SELECT * FROM (VALUES ('temp'), ('sal'), ('u'), ('v')) q(name)")
def dataset_variable_names(spark, d):
    return spark.createDataFrame([(n,) for n in _dataset(spark, d).variable_names()], "name string")


@query("SELECT * FROM (VALUES ('stamp', 't'), ('lev', 'z'), ('nav_lat', 'y'), ('nav_lon', 'x'), ('votemper', '-')) q(name, axis)")
def axis_types(spark, d):
    df = _dataset(spark, d).df
    return spark.createDataFrame([(c, names.axis_type(df, c)) for c in ("stamp", "lev", "nav_lat", "nav_lon", "votemper")], "name string, axis string")


@query("SELECT 'zyxt' AS letters")
def order_of_axes(spark, d):
    df = _dataset(spark, d).df.select("lev", "votemper", "nav_lat", "nav_lon", "stamp")
    return spark.createDataFrame([(names.order(df),)], "letters string")


@query("SELECT 'temp' AS name, 'sea_water_temperature' AS standard_name, 'degC' AS units, 'Temperature' AS long_name UNION ALL SELECT 'lon', 'longitude', 'degrees_east', 'Longitude'")
def formatted_columns(spark, d):
    """What renaming to a standard name says in the metadata of a column, copied on to another table."""
    df = names.format_column(names.format_column(_dataset(spark, d).df, "votemper", "temp"), "nav_lon", "lon")
    copied = names.copy_metadata(df.select((F.col("temp") * 1).alias("temp"), (F.col("lon") * 1).alias("lon")), df, ["temp", "lon"])
    told = {c: copied.schema[c].metadata for c in ("temp", "lon")}
    return spark.createDataFrame([(c, m["standard_name"], m["units"], m["long_name"]) for c, m in told.items()], "name string, standard_name string, units string, long_name string")


_NAMES = "(SELECT s_suppkey AS station, ['temp_u', 'sal', 'ssh_at_t_location', 'DEPTH_w', 'uvw'][CAST(s_suppkey % 5 + 1 AS INT)] AS name FROM supplier)"


@query(f"SELECT station, nullif(regexp_extract(name, '(_at_)?([tuvwf])(_location)?$', 2), '') AS place, regexp_replace(name, '(_at_[tuvwf]_location|_[tuvwf])$', '') || '_v' AS moved, regexp_replace(name, '(_at_[tuvwf]_location|_[tuvwf])$', '') AS base FROM {_NAMES} WHERE name <> 'uvw' AND name <> 'sal' UNION ALL SELECT station, NULL, name || '_v', name FROM {_NAMES} WHERE name IN ('uvw', 'sal')")
def places_of_names(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in ("temp_u", "sal", "ssh_at_t_location", "DEPTH_w", "uvw")]), (F.col("station") % 5 + 1).cast("int"))
    return stations(spark, d).select("station", labels.place(name).alias("place"), labels.at_place(name, "v").alias("moved"), labels.base_name(name).alias("base"))


@query("SELECT s_suppkey AS station, [true, true, false, true, true, false][CAST(s_suppkey % 6 + 1 AS INT)] AS matches FROM supplier")
def matched_names(spark, d):
    names.register("swell", names.Spec(("hs", "swell"), ("sea_surface_swell_wave_significant_height",), "m", "Swell"))
    pairs = [("VOTEMPER", "temp"), ("x", "lon"), ("votemper", "sal"), ("own", "own"), ("Swell_t", "swell"), ("other", "own")]
    told = stations(spark, d).select("station", *[F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), (F.col("station") % 6 + 1).cast("int")).alias(c) for i, c in enumerate(("name", "wanted"))])
    return names.matching(told, "name", "wanted").select("station", "matches")


# profiles

@query(with_("profiles", "SELECT profile, level, round(coalesce(CASE WHEN profile % 3 = 0 THEN temp END, temp * 2), 6) AS t FROM profiles WHERE level % 4 IN (1, 2)"))
def profile_columns(spark, d):
    """Columns under the first of their names that has a value, rows of good quality."""
    p = profiles(spark, d).withColumns({"TEMP_ADJUSTED": F.when(F.col("profile") % 3 == 0, F.col("temp")), "TEMPERATURE": F.col("temp") * 2, "flag": F.col("level") % 4})
    found = prof.quality(prof.aliases(p, {"t": ["temp_adjusted", "temperature"]}), {"flag": [1, 2]})
    return found.select("profile", "level", r6("t").alias("t"))


@query(with_("profiles", "SELECT profile, level, round(depth, 6) AS depth, round(temp, 6) AS temp FROM profiles"))
def saved_profiles(spark, d):
    path = _folder(spark, "profiles")
    files.save_profiles(profiles(spark, d).withColumn("depth", r6("depth")), path, ["profile", "level"])
    return files.read(spark, path).select("profile", "level", "depth", r6("temp").alias("temp"))


@query(with_("profiles", "SELECT profile, level, round(temp, 3) AS temp FROM profiles WHERE profile % 4 <> 0"))
def casts_of_csv(spark, d):
    """Comma-separated casts, of which those with good flags are read."""
    path = _folder(spark, "casts")
    p = profiles(spark, d)
    line = F.concat_ws(",", F.concat(F.lit("p"), "profile"), F.lit("2024-01-01 00:00:00"), F.lit("48.5"), F.lit("-5"), F.col("level").cast("string"), F.format_string("%.3f", F.round("temp", 3)), F.format_string("%.3f", "sal"), F.when(F.col("profile") % 4 == 0, "0111114").otherwise("0111111"))
    p.select(line.alias("platform,time,lat,lon,depth,temp,sal,qc")).write.option("header", True).option("quote", "").csv(path)
    read = files.read(spark, path, "casts")
    return read.select(F.substring("platform", 2, 20).cast("long").alias("profile"), F.col("depth").cast("int").alias("level"), F.round("temp", 3).alias("temp"))


_PRES = "(((1 - c) - sqrt((1 - c) * (1 - c) - 8.84e-6::DOUBLE * -depth)) / 4.42e-6::DOUBLE / 10)"
_KA = f"({fields._poly(seawater.A_W, 'temp')} + {fields._poly(seawater.A_S, 'temp')} * sal + {seawater.A_S32!r}::DOUBLE * pow(sal, 1.5))"
_KB = f"({fields._poly(seawater.B_W, 'temp')} + {fields._poly(seawater.B_S, 'temp')} * sal)"
_COLUMNS = "m AS (SELECT l_suppkey AS station, month(l_shipdate) AS t, -10.0::DOUBLE * l_linenumber AS z, avg(l_quantity) / 2 AS temp, 30 + avg(l_discount) * 50 AS sal FROM lineitem GROUP BY 1, 2, 3)"
_ASKED = "a AS (SELECT buoy, lon, lat, 1 + (buoy % 100) / 9.1::DOUBLE AS t, unnest([-12.5, -33.3, -71.0])::DOUBLE AS z FROM buoys)"
_HAV = "asin(least(1, sqrt(pow(sin(radians(s.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - b.lon) / 2), 2))))"


@query(with_("buoys stations", f"""&{_COLUMNS}, {_ASKED}, n AS (SELECT buoy, station FROM (SELECT buoy, station, row_number() OVER (PARTITION BY buoy ORDER BY {_HAV}, station) AS k FROM buoys b, stations s) WHERE k = 1),
  w AS (SELECT a.*, n.station, (SELECT max(m.t) FROM m WHERE m.station = n.station AND m.t <= a.t) AS t0, (SELECT min(m.t) FROM m WHERE m.station = n.station AND m.t >= a.t) AS t1 FROM a JOIN n USING (buoy)),
  d AS (SELECT w.*, e, CASE e WHEN 0 THEN t0 ELSE t1 END AS te FROM w, (SELECT unnest([0, 1]) AS e)),
  g AS (SELECT buoy, d.z, d.e, any_value(d.t) AS t, any_value(t0) AS t0, any_value(t1) AS t1, any_value(d.station) AS station, max(m.z) FILTER (m.z <= d.z) AS z0, min(m.z) FILTER (m.z >= d.z) AS z1,
    arg_max(m.temp, m.z) FILTER (m.z <= d.z) AS a0, arg_min(m.temp, m.z) FILTER (m.z >= d.z) AS a1, arg_max(m.sal, m.z) FILTER (m.z <= d.z) AS b0, arg_min(m.sal, m.z) FILTER (m.z >= d.z) AS b1 FROM d LEFT JOIN m ON m.station = d.station AND m.t = d.te GROUP BY 1, 2, 3),
  h AS (SELECT *, CASE WHEN z1 > z0 THEN (z - z0) / (z1 - z0) ELSE 0 END AS f, CASE WHEN t1 > t0 THEN (t - t0) / (t1 - t0) ELSE 0 END AS q FROM g),
  i AS (SELECT buoy, z, e, station, q, a0 + f * (a1 - a0) AS temp, b0 + f * (b1 - b0) AS sal FROM h),
  k AS (SELECT buoy, p.z, p.station, p.temp + p.q * (r.temp - p.temp) AS temp, p.sal + p.q * (r.sal - p.sal) AS sal FROM i p JOIN i r USING (buoy) WHERE p.e = 0 AND r.e = 1 AND p.z = r.z),
  o AS (SELECT buoy, k.z AS depth, k.station, temp, sal, 5.92e-3::DOUBLE + 5.25e-3::DOUBLE * pow(sin(radians(buoys.lat)), 2) AS c FROM k JOIN buoys USING (buoy)),
  x AS (SELECT buoy, depth, station, temp, sal, {_PRES} AS p, {fields._RHO0} AS rho0, {fields._K0} AS k0, {_KA} AS ka, {_KB} AS kb FROM o)
  SELECT buoy, round(depth, 6) AS depth, station, round(temp, 6) AS temp, round(sal, 6) AS sal, round(p * 10, 5) AS pres, round(rho0 / (1 - p / (k0 + ka * p + kb * p * p)), 5) AS dens FROM x"""))
def colocated_stratification(spark, d):
    """Temperature, salinity, pressure and density of the nearest model column at the depths and times of profiles."""
    li = table(spark, d, "lineitem")
    model = li.groupBy(F.col("l_suppkey").alias("station"), F.month("l_shipdate").alias("time"), (-10.0 * F.col("l_linenumber")).alias("depth")).agg((F.avg("l_quantity") / 2).alias("temp"), (30 + F.avg("l_discount") * 50).alias("sal"))
    model = model.join(stations(spark, d).select("station", "lon", "lat"), "station")
    asked = buoys(spark, d).select("buoy", "lon", "lat", (1 + (F.col("buoy") % 100) / 9.1).alias("time"), F.explode(F.array(F.lit(-12.5), F.lit(-33.3), F.lit(-71.0))).alias("depth"))
    found = colocate.with_pressure_and_density(colocate.colocate_strata(model, "station", asked, "buoy", 8.0))
    return found.select("buoy", "depth", "station", r6("temp").alias("temp"), r6("sal").alias("sal"), F.round("pres", 5).alias("pres"), F.round("dens", 5).alias("dens"))


# text formats, file sets and tables that grow

@query(with_("buoys", "SELECT round(lon, 6) AS x, round(lat, 6) AS y, round(v, 2) AS z FROM buoys"))
def xyz_text(spark, d):
    path = _folder(spark, "xyz")
    files.write_xyz(buoys(spark, d), path, "lon", "lat", "v")
    return files.read(spark, path, "xyz").select(r6("x").alias("x"), r6("y").alias("y"), F.round("z", 2).alias("z"))


@query(with_("series", "SELECT strftime(t, '%Y/%m/%d %H:%M:%S') AS t, CAST(round(v) AS INT) AS v FROM series"))
def series_text(spark, d):
    path = _folder(spark, "series")
    files.write_series(series(spark, d).withColumn("v", F.round("v").cast("double")), path, "t", "v")
    line = F.split("value", " ")
    return spark.read.text(path).select(F.concat_ws(" ", line[0], line[1]).alias("t"), line[2].cast("double").cast("int").alias("v"))


def _station_file(spark, d) -> str:
    path = _folder(spark, "stations")
    s = stations(spark, d)
    s.select(F.concat(F.rpad("name", 29, " "), F.format_string("%.3f %.3f %.2f", "lat", "lon", "z"))).write.text(path)
    return path


@query(with_("stations", "SELECT name, lat, lon, round(z, 2) AS z FROM stations"))
def station_file(spark, d):
    return files.read(spark, _station_file(spark, d), "stations").withColumn("z", F.round("z", 2))


@query(with_("stations", "SELECT name, lat, lon, round(z, 2) AS z FROM stations WHERE NOT (lon BETWEEN -90 AND 90 AND lat BETWEEN -40 AND 40)"))
def mean_sea_levels(spark, d):
    return files.mean_sea_level(spark, _station_file(spark, d), (-90.0, -40.0, 90.0, 40.0), inverse=True).withColumn("z", F.round("z", 2))


@query("SELECT lower(replace(s_name, '#', '_')) AS name, unnest(['nation', 'title']) AS key, unnest([CAST(s_nationkey AS VARCHAR), s_name || ', a name']) AS value FROM supplier")
def namelist_file(spark, d):
    path = _folder(spark, "namelist")
    group = F.format_string("&%s\n Nation = %s,\n title = '%s, a name' ! as said\n/\n", F.replace("s_name", F.lit("#"), F.lit("_")), F.col("s_nationkey").cast("string"), F.col("s_name"))
    table(spark, d, "supplier").select(group.alias("value")).write.text(path)
    return files.read(spark, path, "namelist").select("name", "key", "value")


@query("SELECT DISTINCT strftime(ts, 'run_%Y%m%d.nc') AS name FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 1 DAY)) AS ts FROM events)")
def dated_files(spark, d):
    """Names of the files of a day each from the first event to the last."""
    lo, hi = table(spark, d, "events").agg(F.min(F.date_trunc("day", "ts")), F.max("ts")).first()
    found = files.dated_names("run_%Y%m%d.nc", lo, hi)
    return spark.createDataFrame([(n,) for n in found], "name string")


def _runs(spark, d):
    """A forecast a day, over that day and the next: the folder of its files. Values of the second day are off by 1000."""
    path = _folder(spark, "runs")
    e = table(spark, d, "events").select("event_id", "ts", "value")
    both = e.withColumn("lead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("day", F.date_sub(F.col("ts").cast("date"), F.col("lead")))
    both = both.select("event_id", "ts", (F.col("value") + 1000 * F.col("lead")).alias("value"), F.concat(F.lit("run_"), F.date_format("day", "yyyyMMdd")).alias("file"))
    both.repartition("file").write.partitionBy("file").parquet(path)
    return path


_SPAN = "ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-09 18:00:00'"


@query(f"SELECT event_id, ts, round(value, 6) AS value, CAST(date_trunc('day', ts) AS TIMESTAMP) AS file_date FROM events WHERE {_SPAN}")
def dated_scan(spark, d):
    """The best estimate of some days from forecasts that overlap; files of other days are not opened."""
    from datetime import datetime

    found = dated.scan(spark, _runs(spark, d), "file=run_%Y%m%d", "ts", datetime(2024, 1, 5, 6), datetime(2024, 1, 9, 18))
    return found.select("event_id", "ts", r6("value").alias("value"), "file_date")


@query(f"SELECT event_id, round(value + 1000 * n, 6) AS value, CAST(date_trunc('day', ts) - to_days(CAST(n AS INT)) AS TIMESTAMP) AS file_date FROM events, (SELECT unnest([0, 1]) AS n) WHERE {_SPAN}")
def dated_scan_of_all_runs(spark, d):
    """Without cutting: every forecast that holds the time."""
    from datetime import datetime

    found = dated.scan(spark, _runs(spark, d), "file=run_%Y%m%d", "ts", datetime(2024, 1, 5, 6), datetime(2024, 1, 9, 18), cut=False)
    return found.select("event_id", r6("value").alias("value"), "file_date")


_PATTERN = "event_type || ['_%Y.nc', '_%Y%m', '_%m%d%H', ''][CAST(event_id % 4 + 1 AS INT)]"


@query(f"SELECT event_id, ['year', 'month', 'hour', NULL][CAST(event_id % 4 + 1 AS INT)] AS unit, replace(replace(replace(replace({_PATTERN}, '%Y', '[0-9][0-9][0-9][0-9]'), '%m', '[0-1][0-9]'), '%d', '[0-3][0-9]'), '%H', '[0-2][0-9]') AS \"glob\" FROM events")
def patterns_of_files(spark, d):
    ends = F.array(*[F.lit(e) for e in ("_%Y.nc", "_%Y%m", "_%m%d%H", "")])
    pattern = F.concat("event_type", F.element_at(ends, (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, d, "events").select("event_id", files.frequencies(pattern).alias("unit"), files.globs(pattern).alias("glob"))


@query("SELECT 'orders' AS name, true AS found UNION ALL SELECT 'lineitem', true UNION ALL SELECT 'nothing', false")
def found_files(spark, d):
    """Tables of the folder whose path matches, and that they have bytes."""
    rows = []
    for name in ("orders", "lineitem", "nothing"):
        rows.append((name, not files.find(spark, f"{d}/*.parquet", f".*{name}.*parquet$").filter("length > 0").isEmpty()))
    return spark.createDataFrame(rows, "name string, found boolean")


@query("SELECT p_partkey AS part, p_size * [1048576, 1024, 1, 1073741824][CAST(p_partkey % 4 + 1 AS INT)]::DOUBLE AS bytes FROM part")
def parsed_sizes(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in (" Mo", "kio", "", ".0 Gio")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), files.sizes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("SELECT count(*) AS n FROM nation")
def registered_reader(spark, d):
    """A reader of one's own, under a name; and a dataset opened with it."""
    files.register("doubled", lambda spark, paths, **options: spark.read.parquet(paths).unionByName(spark.read.parquet(paths)))
    return open_dataset(spark, f"{d}/nation.parquet", "doubled").df.agg((F.count(F.lit(1)) / 2).cast("long").alias("n"))


@query(with_("buoys", "SELECT buoy, round(v, 6) AS v FROM buoys"))
def cached_records(spark, d):
    """A table that takes the rows it does not have yet, twice."""
    path = _folder(spark, "cache")
    b = buoys(spark, d)
    append_missing(b.filter("buoy % 3 != 0"), path, ["buoy"])
    append_missing(b, path, ["buoy"])
    return files.read(spark, path).select("buoy", r6("v").alias("v"))


# the bank of soundings

def _bank(spark, d) -> Bank:
    bank = Bank(spark, _folder(spark, "bank"))
    bank.add(buoys(spark, d).select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("v").alias("z")), "buoys")
    bank.add(stations(spark, d).select((F.col("lon") / 4).alias("x"), (F.col("lat") / 4).alias("y"), "z"), "stations")
    bank.copy("stations", "twin")
    bank.add(bank.load("stations").filter("x > 1000"), "empty")
    bank.remove("empty")
    return bank


_BANK = "bank AS (SELECT 'buoys' AS id, lon AS x, lat AS y, v AS z FROM buoys UNION ALL SELECT 'stations', lon / 4, lat / 4, z FROM stations UNION ALL SELECT 'twin', lon / 4, lat / 4, z FROM stations)"


@query(with_("stations buoys", f"&{_BANK} SELECT id, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM bank GROUP BY 1 HAVING max(x) >= 50 - 12"))
def bank_by_box(spark, d):
    return _bank(spark, d).select(xmin=50.0, margin=12.0)


@query(with_("stations buoys", f"&{_BANK} SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM bank WHERE id <> 'buoys'"))
def bank_points(spark, d):
    return _bank(spark, d).table().filter("id != 'buoys'").select("id", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query(with_("stations buoys", f"&{_BANK} SELECT id, count(*) AS n FROM bank WHERE id <> 'buoys' GROUP BY 1"))
def bank_merged(spark, d):
    """Of two sets at the same places, both of which stay, as neither is opaque."""
    return _bank(spark, d).merged(["stations", "twin"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


# shapes as tables

_SHAPES = "s AS (SELECT n_nationkey AS id, 1.0::DOUBLE + n_nationkey % 7 AS w, 2.0::DOUBLE + n_nationkey % 5 AS h, 10.0::DOUBLE * (n_nationkey % 6) - 25 AS x, 8.0::DOUBLE * (n_nationkey % 9) - 30 AS y FROM nation)"


def _shapes(spark, d):
    k = F.col("n_nationkey")
    s = table(spark, d, "nation").select(k.alias("id"), (1.0 + k % 7).alias("w"), (2.0 + k % 5).alias("h"), (10.0 * (k % 6) - 25).alias("x"), (8.0 * (k % 9) - 30).alias("y"))
    corner = lambda a, b: F.struct((F.col("x") + a * F.col("w")).alias("x"), (F.col("y") + b * F.col("h")).alias("y"))
    return s.select("id", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("shape"))


@query(f"WITH {_SHAPES} SELECT id, 4 AS n, w * h AS area, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax FROM s")
def shapes_as_table(spark, d):
    return points.shape_table(_shapes(spark, d)).drop("shape")


@query(f"WITH {_SHAPES} SELECT area FROM (SELECT w * h AS area FROM s ORDER BY 1 DESC LIMIT 3)")
def largest_shapes(spark, d):
    return points.largest_shapes(_shapes(spark, d), 3).select("area")


@query(f"WITH {_SHAPES} SELECT id, CAST(k AS INT) AS n, x + CASE WHEN k IN (1, 2) THEN w ELSE 0 END AS x, y + CASE WHEN k > 1 THEN h ELSE 0 END AS y FROM s, range(4) q(k)")
def points_of_shapes(spark, d):
    return points.shape_points(_shapes(spark, d), "id")


@query(f"WITH {_SHAPES}, c AS (SELECT id, greatest(x, -12) AS a, least(x + w, 9) AS b, greatest(y, -15) AS c, least(y + h, 11) AS e FROM s) SELECT id, round((b - a) * (e - c), 6) AS area FROM c WHERE b > a AND e > c")
def clipped_shapes(spark, d):
    kept = points.clip_shapes(_shapes(spark, d), (-12.0, -15.0, 9.0, 11.0))
    return points.shape_table(kept).select("id", r6("area").alias("area")).filter("area > 0")


@query(f"WITH {_SHAPES} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM s")
def projected_shapes(spark, d):
    """To the plane and back."""
    back = points.projected(points.projected(_shapes(spark, d)), inverse=True)
    return back.select("id", r6(F.col("shape")[0]["x"]).alias("x"), r6(F.col("shape")[0]["y"]).alias("y"))


@query(f"WITH {_SHAPES}, l AS (SELECT w AS v FROM s UNION ALL SELECT w FROM s UNION ALL SELECT h FROM s UNION ALL SELECT h FROM s) SELECT quantile_disc(v, 0.5) AS resolution FROM l")
def resolution_of_shapes(spark, d):
    return points.side_length(_shapes(spark, d))


# scalar helpers

@query(with_("buoys", "SELECT buoy, CASE WHEN buoy % 3 <> 0 AND buoy % 4 <> 0 THEN lon END AS a, CASE WHEN buoy % 3 <> 0 AND buoy % 4 <> 0 THEN lat END AS b FROM buoys"))
def merged_masks(spark, d):
    b = buoys(spark, d).select("buoy", F.when(F.col("buoy") % 3 != 0, F.col("lon")).alias("a"), F.when(F.col("buoy") % 4 != 0, F.col("lat")).alias("b"))
    return select.merge_masks(b, ["a", "b"])


@query(with_("buoys", "SELECT buoy, abs(lon - lat) <= 1 + 0.1 * abs(lat) AS close, CASE buoy % 4 WHEN 0 THEN lon WHEN 1 THEN lat WHEN 2 THEN 7 END AS chosen FROM buoys"))
def close_and_chosen(spark, d):
    close = select.close_to(F.col("lon"), F.col("lat"), 0.1, 1.0)
    chosen = maps.choose((F.col("buoy") % 4).cast("int"), F.col("lon"), F.col("lat"), F.lit(7.0))
    return buoys(spark, d).select("buoy", close.alias("close"), chosen.alias("chosen"))


@query(with_("buoys", "SELECT buoy, greatest(least(lon, lat), -30) AS lo, least(greatest(lon, lat), 20) AS hi FROM buoys WHERE greatest(least(lon, lat), -30) <= least(greatest(lon, lat), 20)"))
def shared_segments(spark, d):
    s = select.overlap((F.col("lon"), F.col("lat")), (F.lit(20.0), F.lit(-30.0)))
    return buoys(spark, d).select("buoy", s.alias("s")).filter("s is not null").select("buoy", "s.lo", "s.hi")


@query(with_("buoys", "SELECT buoy, lon, lat FROM buoys"))
def squeezed_axes(spark, d):
    return select.squeeze(buoys(spark, d).select("buoy", "lon", "lat", F.lit(3).alias("level"), F.lit("one").alias("run")), ["lon", "lat", "level", "run"])


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = n_nationkey % 2 THEN 1 ELSE 2 END AS distinct_, CAST(n_nationkey AS VARCHAR) AS a, n_nationkey % 5 = 0 AS none FROM nation")
def option_maps(spark, d):
    """Options by prefix, by alias, and lists without repeats."""
    k = F.col("n_nationkey")
    m = F.create_map(F.lit("plot_a"), k.cast("string"), F.lit("plot_b"), F.lit("x"), F.lit("other"), F.lit("y"))
    part = maps.with_prefix(m, "plot")
    none = F.when(k % 5 == 0, maps.first_of(maps.without_prefix(m, "plot"), "plot_a")).otherwise(maps.first_of(m, "nothing", "other")).isNull()
    return table(spark, d, "nation").select(k.alias("id"), F.size(maps.unique(F.array(k % 3, k % 2))).alias("distinct_"), maps.first_of(part, "a").alias("a"), none.alias("none"))


@query("SELECT n_nationkey AS id, replace(CAST(CAST(n_nationkey * 2.5 AS DOUBLE) AS VARCHAR), '.0', '') || 'm' AS depth, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 0.5::DOUBLE ELSE -(n_nationkey + 0.25::DOUBLE) END AS degrees FROM nation")
def depth_labels(spark, d):
    k = F.col("n_nationkey")
    text = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("°30'N"))).otherwise(F.concat(k.cast("string"), F.lit("°15'W")))
    depth = F.regexp_replace(labels.depth(k * -2.5), r"(\.\d*?)0+m$|\.0*m$", "$1m")
    return table(spark, d, "nation").select(k.alias("id"), F.regexp_replace(depth, r"\.m$", "m").alias("depth"), labels.parse_degrees(text).alias("degrees"))


@query(with_("buoys", """&t AS (SELECT buoy, lon + 0.013::DOUBLE AS c, CAST(round(abs(lon + 0.013::DOUBLE) * 3600) AS BIGINT) AS s FROM buoys)
  SELECT buoy, s // 3600 || '°' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || '''' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '''''' || CASE WHEN c < 0 THEN 'W' ELSE 'E' END AS dms, CASE WHEN c < 0 THEN '-' ELSE '' END || printf('%.2f', abs(c)) || '°' AS plain FROM t"""))
def phase_labels(spark, d):
    c = F.col("lon") + 0.013
    return buoys(spark, d).select("buoy", labels.phase(c, "lon").alias("dms"), labels.phase(c, decimals=2).alias("plain"))


@query("SELECT kind, k AS place, lo + to_microseconds(CAST(round(k * date_diff('microsecond', lo, hi) / 7.0::DOUBLE) AS BIGINT)) AS t FROM (SELECT event_type AS kind, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1), range(8) q(k)")
def linear_dates(spark, d):
    """Eight times from the first event of a kind to the last."""
    ends = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return ends.select("kind", F.posexplode(times.linear_dates(F.col("lo"), F.col("hi"), 8)).alias("place", "t")).withColumn("place", F.col("place").cast("long"))


@query("SELECT event_id, CAST(dayofyear(ts) AS INT) AS day FROM events")
def day_of_the_year(spark, d):
    return table(spark, d, "events").select("event_id", times.day_of_year(F.col("ts")).alias("day"))


@query("""WITH s AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, ts FROM events), b AS (SELECT k, CASE k WHEN 0 THEN date_trunc('year', ts) WHEN 1 THEN date_trunc('quarter', ts) WHEN 2 THEN date_trunc('month', ts)
  WHEN 3 THEN date_trunc('month', ts) + to_days(CAST(least((day(ts) - 1) // 10, 2) * 10 AS INT)) ELSE date_trunc('day', ts) END AS start, count(*) AS n FROM s GROUP BY 1, 2),
  c AS (SELECT coalesce(min(k) FILTER (m < (SELECT count(*) / 4 FROM events)), 4) AS best FROM (SELECT k, max(n) AS m FROM b GROUP BY 1)) SELECT CAST(start AS TIMESTAMP) AS start, n FROM b JOIN c ON k = best""")
def smart_split(spark, d):
    """Intervals that hold less than a quarter of all events each."""
    e = table(spark, d, "events")
    return times.smart_split(e, "ts", -(-e.count() // 4))


@query(with_("field", "SELECT j, i FROM (SELECT j, i, floor((i - min(i) OVER (PARTITION BY j)) / 3) AS k, lag(i) OVER (PARTITION BY j ORDER BY i) AS b, min(i) OVER (PARTITION BY j) AS a FROM field) WHERE b IS NULL OR k <> floor((b - a) / 3)"))
def thinned_grid(spark, d):
    """Cells of each row of the field at which the way along it passes a multiple of three steps."""
    grid = field(spark, d).withColumns({"x": F.col("i").cast("double"), "y": F.col("j").cast("double")})
    return select.thin_by_distance(grid, ["j"], "i", "x", "y", 3.0).select("j", "i")


_H = "buoy % 31 / 4.0::DOUBLE"


@query(with_("buoys", f"SELECT buoy, CASE WHEN h > 0 THEN round(0.1 + 0.9 * (1 - exp(-3 * h / 4)), 6) ELSE 0 END AS exponential, CASE WHEN h > 0 THEN round(0.1 + 0.9 * least(h / 4, 1), 6) ELSE 0 END AS linear, CASE WHEN h > 0 THEN round(CASE WHEN h < 4 THEN 0.1 + 0.9 * (1.5 * h / 4 - 0.5 * pow(h / 4, 3)) ELSE 1 END, 6) ELSE 0 END AS spherical, CASE WHEN h > 0 THEN round(0.1 + 0.9 * (1 - exp(-3 * pow(h / 4, 2))), 6) ELSE 0 END AS gaussian FROM (SELECT buoy, {_H} AS h FROM buoys)"))
def variogram_models(spark, d):
    h = F.col("buoy") % 31 / 4.0
    return buoys(spark, d).select("buoy", *[r6(kriging.model_column(k, h, 0.1, 1.0, 4.0)).alias(k) for k in ("exponential", "linear", "spherical", "gaussian")])


@query(with_("buoys", "SELECT buoy, round(exp(-(pow((x + 1) / 1, 2) + pow(y - 0.5, 2))) - exp(-(pow((x - 1) / 2, 2) + pow((y - 1) / 0.5, 2))) + 0.8 * exp(-(pow(x / 0.5, 2) + pow((y + 1.5) / 0.5, 2))), 6) AS z FROM (SELECT buoy, lon / 90 AS x, lat / 40 AS y FROM buoys)"))
def test_surface(spark, d):
    return buoys(spark, d).select("buoy", r6(kriging.three_gaussians(F.col("lon") / 90, F.col("lat") / 40)).alias("z"))


@query(with_("buoys", """&p AS (SELECT sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) AS d, pow(b.v - a.v, 2) / 2 AS g FROM buoys a JOIN buoys b ON a.buoy < b.buoy AND abs(b.lon - a.lon) <= 20 AND abs(b.lat - a.lat) <= 20),
  n AS (SELECT * FROM p WHERE d < 20), e AS (SELECT quantile_disc(d, 0.5) AS m FROM n) SELECT CAST(d > m AS INT) AS bin, round(avg(d), 6) AS distance, round(avg(g), 3) AS gamma, count(*) AS pairs FROM n, e GROUP BY 1"""))
def variogram_of_equal_counts(spark, d):
    found = kriging.equal_count_bins(buoys(spark, d), "buoy", 20.0, 2, "lon", "lat", "v", accuracy=1_000_000)
    return found.select("bin", r6("distance").alias("distance"), F.round("gamma", 3).alias("gamma"), "pairs")


@query()
def variograms_fitted_together(spark, d):
    """Median parameters of the variograms of the buoys of each nation."""
    b = table(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("part"), F.col("c_custkey").alias("buoy")).join(buoys(spark, d), "buoy")
    parts = None
    for k in range(3):
        one = kriging.variogram(b.filter(F.col("part") == k), "buoy", 2.5, 20.0, "lon", "lat", "v").withColumn("part", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    return kriging.fit_several(parts, ["part"])


@query()
def simple_kriging(spark, d):
    """Buoys' values at the stations, about a mean that is known."""
    return kriging.krige(buoys(spark, d), stations(spark, d), "station", 20.0, "exponential", 0.0, 1.0, 30.0, x="lon", y="lat", value="v", mean=4500.0)


@query(with_("field masked", "SELECT j, i, round(v, 6) AS v FROM masked WHERE v IS NOT NULL"))
def compressed_cells(spark, d):
    from halocline.operators.regrid import compress

    return compress(masked(spark, d), "v").select("j", "i", r6("v").alias("v"))


# units, heights, grids from axes

@query(with_("buoys", """SELECT buoy, round(lat * 1000, 6) AS density, round(lat * 0.01::DOUBLE, 9) AS speed, round(lat * 3.6, 6) AS kmh, round(lat * 1.8 + 32, 6) AS degf, round(lat * 100, 6) AS pascal FROM buoys"""))
def compound_units(spark, d):
    from halocline.functions.units import convert

    c = F.col("lat")
    return buoys(spark, d).select(
        "buoy", r6(convert(c, "g cm-3", "kg m-3")).alias("density"), F.round(convert(c, "cm s-1", "m/s"), 9).alias("speed"), r6(convert(c, "m s^-1", "km/h")).alias("kmh"), r6(convert(c, "degC", "degF")).alias("degf"),
        r6(convert(c, "hPa", "Pa")).alias("pascal"),
    )


@query(with_("profiles", "SELECT profile, level, round(level * 0.1::DOUBLE / 40 * (40 - (profile % 7) * 100) + (profile % 7) * 100, 6) AS altitude FROM profiles"))
def altitudes(spark, d):
    from halocline.functions.seawater import sigma_altitude

    p = profiles(spark, d)
    return p.select("profile", "level", r6(sigma_altitude(F.col("level") * 0.1, F.lit(40.0), (F.col("profile") % 7) * 100)).alias("altitude"))


@query("SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT l_linenumber AS j, avg(l_quantity) AS y FROM lineitem GROUP BY 1), (SELECT month(l_shipdate) AS i, avg(l_discount) AS x FROM lineitem GROUP BY 1)")
def grid_from_axes(spark, d):
    """Every line number with every month, at their means."""
    from halocline.operators.grid import grid_of_axes

    li = table(spark, d, "lineitem")
    x = li.groupBy(F.month("l_shipdate").alias("k")).agg(F.avg("l_discount").alias("x"))
    y = li.groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_quantity").alias("x"))
    return grid_of_axes(x, y).select("j", "i", r6("x").alias("x"), r6("y").alias("y"))


@query(with_("field", "SELECT j, i, round(v, 6) AS v, i * 12.0::DOUBLE - 180 AS x, j * 8.0::DOUBLE - 80 AS y FROM field"))
def field_on_grid(spark, d):
    from halocline.operators.grid import make_grid, on_grid

    return on_grid(field(spark, d), make_grid(spark, 30, 20, -180.0, 12.0, -80.0, 8.0)).select("j", "i", r6("v").alias("v"), "x", "y")


@query(with_("field masked", "SELECT j, i, i * 12.0::DOUBLE - 180 AS x, j * 8.0::DOUBLE - 80 AS y, round(v, 6) AS z FROM masked"))
def saved_bathymetry(spark, d):
    """A gridded bathymetry written and read again, masked cells as nulls."""
    grid = masked(spark, d).select("j", "i", (F.col("i") * 12.0 - 180).alias("x"), (F.col("j") * 8.0 - 80).alias("y"), F.col("v").alias("z"))
    path = _folder(spark, "bathymetry")
    files.save_grid(grid, path)
    return files.read(spark, path).withColumn("z", r6("z"))


@query(with_("field masked", "SELECT j, i, CASE WHEN NOT (i * 12.0 - 180 >= -101.3 AND i * 12.0 - 180 < 48.9 AND j * 8.0 - 80 >= -41.7 AND j * 8.0 - 80 < 29.3) THEN round(v, 6) END AS v FROM masked"))
def masked_bathymetry(spark, d):
    cells = masked(spark, d).withColumns({"lon": F.col("i") * 12.0 - 180, "lat": F.col("j") * 8.0 - 80})
    land = [[(-101.3, -41.7), (48.9, -41.7), (48.9, 29.3), (-101.3, 29.3)]]
    return points.mask_land(cells, "v", land, 12.0, 8.0, mode="inside").select("j", "i", r6("v").alias("v"))


@query(with_("stations field masked", """&p AS (SELECT station, lat, (lon + 180) / 12.0::DOUBLE AS x, (lat + 80) / 8.0::DOUBLE AS y FROM stations), c AS (SELECT station, CAST(floor(y) AS INT) + b AS j, CAST(floor(x) AS INT) + a AS i,
  greatest(sqrt(pow((x - floor(x) - a) * 12 * cos(radians(lat)), 2) + pow((y - floor(y) - b) * 8, 2)), 1e-12) AS r FROM p, range(2) r(a), range(2) q(b))
  SELECT station, round(sum(v / r) / sum(CASE WHEN v IS NOT NULL THEN 1 / r END), 6) AS value FROM c LEFT JOIN masked USING (j, i) GROUP BY 1"""))
def distance_weights_on_the_sphere(spark, d):
    from halocline.operators.grid import at_points

    at = stations(spark, d).select("station", "lon", "lat")
    return at_points(masked(spark, d), at, [], "v", -180.0, 12.0, -80.0, 8.0, "dstwgt", "lon", "lat", geo=True).select("station", r6("value").alias("value"))


@query("""WITH g AS (SELECT CAST(l_linenumber - 1 AS INT) AS j, CAST(month(l_shipdate) - 1 AS INT) AS i, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
  SELECT CAST(a AS INT) AS j, CAST(b AS INT) AS i, round(avg(v), 6) AS v FROM range(13) p(a), range(23) q(b), range(2) r(y), range(2) s(x) JOIN g ON g.j = (a + y) // 2 AND g.i = (b + x) // 2 GROUP BY 1, 2""")
def refined_field(spark, d):
    """A field of line numbers and months on a grid twice as fine."""
    li = table(spark, d, "lineitem")
    rough = li.groupBy((F.col("l_linenumber") - 1).cast("int").alias("j"), (F.month("l_shipdate") - 1).cast("int").alias("i")).agg(F.avg("l_quantity").alias("v"))
    return sections.refine(rough, "v", 2, 7, 12).select("j", "i", r6("v").alias("v"))


@query(with_("stations", """&s AS (SELECT station AS k, lon + sin(station * 1.7::DOUBLE) AS x, lat + cos(station * 2.3::DOUBLE) AS y FROM stations),
  n AS (SELECT a.k, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM s a JOIN s b ON a.x <> b.x OR a.y <> b.y GROUP BY 1) SELECT round(d, 6) AS spacing FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS m FROM n) WHERE r = (m + 1) // 2"""))
def spacing_of_points(spark, d):
    from halocline.operators.scatter import spacing
    from halocline.plans.gridding import _moved

    return spacing(_moved(spark, d), "k", 400.0).select(r6("spacing").alias("spacing"))
