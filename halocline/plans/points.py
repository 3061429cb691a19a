"""Queries: distances, nearest neighbours, polygons, duplicates, overlay, scattered data, names, scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.functions import geo, labels, units
from halocline.operators import islands, kriging, points
from halocline.plans.inputs import buoys, casts, field, masked, profiles, r6, stations, table, with_
from halocline.plans.registry import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)

_R = units.EARTH_RADIUS


def _haversine(a: str, b: str) -> str:
    return f"(2 * {_R!r}::DOUBLE * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


@query(with_("stations buoys", f"""SELECT buoy, station AS nearest, round(d, 3) AS distance FROM (SELECT buoy, station, {_haversine("b", "s")} AS d, row_number() OVER (PARTITION BY buoy ORDER BY {_haversine("b", "s")}, station) AS k FROM buoys b, stations s) WHERE k = 1"""))
def nearest_station(spark, d):
    found = points.nearest(buoys(spark, d), "buoy", stations(spark, d), "station", 8.0)
    return found.select("buoy", "nearest", F.round("distance", 3).alias("distance"))


@query(with_("stations buoys", f"SELECT buoy AS id, round({_haversine('b', 's')}, 3) AS distance FROM buoys b JOIN stations s ON buoy = station"))
def pairwise_distance(spark, d):
    found = points.distances(buoys(spark, d).withColumnRenamed("buoy", "id"), stations(spark, d).withColumnRenamed("station", "id"), "id")
    return found.select("id", F.round("distance", 3).alias("distance"))


_POLYGON = [(-120.3, -40.2), (60.7, -55.1), (130.9, 20.3), (20.1, 65.4), (-90.6, 30.8)]


def _inside_sql() -> str:
    sides = zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True)
    crossed = " + ".join(f"CASE WHEN ({ay} > lat) <> ({by} > lat) AND lon < ({bx} - ({ax}))::DOUBLE * (lat - ({ay})) / ({by} - ({ay}))::DOUBLE + ({ax}) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in sides)
    return f"({crossed}) % 2 = 1"


@query(with_("buoys", f"SELECT buoy FROM buoys WHERE {_inside_sql()}"))
def select_in_polygon(spark, d):
    return points.select(buoys(spark, d), [_POLYGON]).select("buoy")


@query(with_("buoys", f"SELECT buoy FROM buoys WHERE NOT ({_inside_sql()})"))
def exclude_polygon(spark, d):
    return points.select(buoys(spark, d), [_POLYGON], reverse=True).select("buoy")


@query(with_("stations buoys", f"SELECT buoy AS id, 'buoy' AS kind FROM buoys WHERE NOT ({_inside_sql()}) UNION ALL SELECT station, 'station' FROM stations"))
def overlay_points(spark, d):
    low = buoys(spark, d).select(F.col("buoy").alias("id"), F.lit("buoy").alias("kind"), "lon", "lat")
    top = stations(spark, d).select(F.col("station").alias("id"), F.lit("station").alias("kind"), "lon", "lat")
    return points.overlay([low, top], [None, _POLYGON], "lon", "lat").select("id", "kind")


@query(with_("field", f"""&c AS (SELECT j, i, CAST({_inside_sql().replace("lat", "y").replace("lon", "x")} AS INT) AS hit FROM (SELECT j, i, i * 12.0::DOUBLE - 180 + a * 12 AS x, j * 8.0::DOUBLE - 80 + b * 8 AS y FROM field,
  (VALUES (-0.375::DOUBLE), (-0.125), (0.125), (0.375)) p(a), (VALUES (-0.375::DOUBLE), (-0.125), (0.125), (0.375)) q(b)))
  SELECT j, i, sum(hit) / 16.0::DOUBLE AS fraction FROM c GROUP BY 1, 2"""))
def polygon_fraction(spark, d):
    cells = field(spark, d).select("j", "i", (F.col("i") * 12.0 - 180).alias("lon"), (F.col("j") * 8.0 - 80).alias("lat"))
    return points.mask_fraction(cells, _POLYGON, 12.0, 8.0).select("j", "i", "fraction")


@query(with_("casts", """&r AS (SELECT *, upper(trim(platform)) AS p FROM casts),
  c AS (SELECT a.cast_id, bool_or((NOT a.corrupted AND b.t = a.t OR a.corrupted AND abs(date_diff('second', a.t, b.t)) <= 43200) AND (b.corrupted < a.corrupted OR b.corrupted = a.corrupted AND b.cast_id < a.cast_id)) AS duplicate
    FROM r a JOIN r b ON a.p = b.p AND a.lat = b.lat AND a.lon = b.lon GROUP BY 1) SELECT cast_id, duplicate FROM c"""))
def duplicate_casts(spark, d):
    return points.duplicates(casts(spark, d), "cast_id", "platform", "t", "corrupted", ["lat", "lon"]).select("cast_id", "duplicate")


@query(with_("buoys", """SELECT buoy FROM (SELECT buoy, row_number() OVER (PARTITION BY floor(lon / 25), floor(lat / 25) ORDER BY sqrt(pow((floor(lon / 25) + 0.5) * 25 - lon, 2) + pow((floor(lat / 25) + 0.5) * 25 - lat, 2)), buoy) AS k FROM buoys) WHERE k = 1"""))
def thin_points(spark, d):
    return points.thin(buoys(spark, d), "buoy", 25.0, "lon", "lat").select("buoy")


@query(with_("buoys", "SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM buoys"))
def extent(spark, d):
    return points.box_of(buoys(spark, d))


@query(with_("profiles", """&n AS (SELECT profile, max(depth) FILTER (depth <= -25) AS lo, arg_max(temp, depth) FILTER (depth <= -25) AS a, min(depth) FILTER (depth >= -25) AS hi, arg_min(temp, depth) FILTER (depth >= -25) AS b FROM profiles GROUP BY 1)
  SELECT profile, round(a + (b - a) * (-25 - lo) / (hi - lo), 6) AS temp FROM n WHERE lo IS NOT NULL AND hi IS NOT NULL"""))
def layer_at_depth(spark, d):
    """Temperature 25 m down, of profiles that have levels on both sides of it, between the nearest of either side."""
    from halocline.operators import interp

    found = interp.at_position(profiles(spark, d, together=500_000), ["profile"], "depth", "temp", -25.0).filter("value is not null")
    return found.select("profile", r6("value").alias("temp"))


@query(with_("stations buoys", f"""&n AS (SELECT station, buoy, v, {_haversine("s", "b")} AS d FROM stations s JOIN buoys b ON abs(b.lat - s.lat) <= 5)
  SELECT station, round(arg_min(v, d), 6) AS model FROM (SELECT * FROM n WHERE d <= 400000) GROUP BY 1"""))
def colocate(spark, d):
    """Value of the buoy nearest to each station, if one is within 400 km."""
    near = points.nearest(stations(spark, d), "station", buoys(spark, d), "buoy", 8.0).filter("distance <= 400000")
    return near.join(buoys(spark, d), F.col("nearest") == F.col("buoy")).select("station", r6("v").alias("model"))


@query(with_("field masked", """SELECT j, i, lake, n FROM (SELECT 1)""").replace("WITH ", "WITH RECURSIVE ").replace("SELECT j, i, lake, n FROM (SELECT 1)", """, w AS (SELECT j * 100 + i AS c, j, i FROM masked WHERE v IS NOT NULL),
  r(c, j, i, root) AS (SELECT c, j, i, c FROM w UNION SELECT w.c, w.j, w.i, r.root FROM r JOIN w ON abs(w.j - r.j) + abs(w.i - r.i) = 1),
  m AS (SELECT c, j, i, min(root) AS root FROM r GROUP BY 1, 2, 3)
  SELECT j, i, CAST(root // 100 AS INT) AS lake_j, CAST(root % 100 AS INT) AS lake_i, count(*) OVER (PARTITION BY root) AS cells FROM m"""))
def lakes(spark, d):
    """Connected water cells: lake of each cell, and its size."""
    return islands.label(masked(spark, d), [], F.col("v").isNotNull())


@query(with_("buoys", """&p AS (SELECT a.buoy, sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) AS d, pow(b.v - a.v, 2) / 2 AS g FROM buoys a JOIN buoys b ON a.buoy < b.buoy AND abs(b.lon - a.lon) <= 20 AND abs(b.lat - a.lat) <= 20)
  SELECT CAST(floor(d / 2.5) AS INT) AS bin, round(avg(d), 6) AS distance, round(avg(g), 3) AS gamma, count(*) AS pairs FROM p WHERE d < 20 GROUP BY 1"""))
def variogram(spark, d):
    found = kriging.variogram(buoys(spark, d), "buoy", 2.5, 20.0, "lon", "lat", "v")
    return found.select("bin", r6("distance").alias("distance"), F.round("gamma", 3).alias("gamma"), "pairs")


@query()
def kriged_stations(spark, d):
    """Buoys' values at the stations, by ordinary kriging from clouds."""
    return kriging.krige_clouds(buoys(spark, d), stations(spark, d), "station", "exponential", 0.1, 1.0, 30.0, x="lon", y="lat", value="v")


@query()
def kriged_in_squares(spark, d):
    """The same from the squares around each station."""
    return kriging.krige(buoys(spark, d), stations(spark, d), "station", 20.0, "exponential", 0.1, 1.0, 30.0, x="lon", y="lat", value="v")


@query()
def kriged_with_errors(spark, d):
    """Simple kriging about a known mean, observations with errors of their own."""
    at = buoys(spark, d).withColumn("e", (F.col("buoy") % 7) / 10.0)
    return kriging.krige_clouds(at, stations(spark, d), "station", "spherical", 0.0, 1.0, 40.0, x="lon", y="lat", value="v", error="e", mean=4500.0)


@query(with_("stations", """SELECT station, round(lon + 10, 6) AS x, round(-lat, 6) + 0.0::DOUBLE AS y, round(abs(10 * (0 - lat) - (-lon) * 10) / sqrt(200::DOUBLE), 6) + 0.0::DOUBLE AS line FROM stations"""))
def plane_geometry(spark, d):
    x, y = geo.rotate(F.col("lon"), F.col("lat"), 180.0, 0.0, 0.0)
    line = geo.distance_to_line(F.col("lon"), F.col("lat"), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    return stations(spark, d).select("station", r6(F.col("lon") + 10).alias("x"), (r6(y) + 0.0).alias("y"), (r6(line) + 0.0).alias("line"))


_DMS = "CAST(floor(abs({c})) AS INT) || '°' || lpad(CAST(CAST(floor((abs({c}) - floor(abs({c}))) * 60) AS INT) AS VARCHAR), 2, '0') || '''' || CASE WHEN {c} < 0 THEN '{n}' ELSE '{p}' END"


@query(with_("buoys", f"SELECT buoy, {_DMS.format(c='(lon + 0.013::DOUBLE)', n='W', p='E')} AS lon, {_DMS.format(c='(lat + 0.013::DOUBLE)', n='S', p='N')} AS lat FROM buoys"))
def position_labels(spark, d):
    return buoys(spark, d).select("buoy", labels.longitude(F.col("lon") + 0.013).alias("lon"), labels.latitude(F.col("lat") + 0.013).alias("lat"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\n]+', ' ', 'g')) AS plain FROM pages")
def plain_text_of_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(labels.strip_tags(F.col("html"), " "), r"[ \n]+", " ")).alias("plain"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(lower(s_name), '0+1[0-9]$')")
def station_search(spark, d):
    return table(spark, d, "supplier").filter(labels.matches(F.col("s_name"), "0+1[0-9]$")).select("s_suppkey", "s_name")


@query("""SELECT c_custkey, CASE WHEN n < 1024 THEN printf('%.1f o', n) WHEN n < 1048576 THEN printf('%.1f Kio', n / 1024) ELSE printf('%.1f Mio', n / 1048576) END AS size FROM (SELECT c_custkey, (c_custkey * 977 + 0.013)::DOUBLE AS n FROM customer)""")
def size_labels(spark, d):
    n = F.col("c_custkey") * 977 + F.lit(0.013)
    return table(spark, d, "customer").select("c_custkey", labels.size(n).alias("size"))
