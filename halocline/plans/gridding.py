"""Queries: fields to other grids, geometry of grids, scattered points, masks by polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.operators import points, regrid, scatter, sections
from halocline.plans.inputs import buoys, masked, profiles, r6, stations, table, with_
from halocline.plans.registry import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


# the field's axes (12 and 8 degrees a cell), and those of a grid that shares none of its edges


def _axes(spark):
    line = lambda n, start, step: regrid.axis(spark.range(n).select(F.col("id").alias("k"), (start + F.col("id") * step).alias("x")))
    return (line(30, -180.0, 12.0), line(17, -171.0, 19.0)), (line(20, -80.0, 8.0), line(13, -71.0, 10.5))


_AXES = """sx AS (SELECT CAST(i AS INT) AS i, i * 12.0::DOUBLE - 180 AS x FROM range(30) r(i)), tx AS (SELECT CAST(i AS INT) AS ti, i * 19.0::DOUBLE - 171 AS tx FROM range(17) r(i)),
  sy AS (SELECT CAST(j AS INT) AS j, j * 8.0::DOUBLE - 80 AS y FROM range(20) r(j)), ty AS (SELECT CAST(j AS INT) AS tj, j * 10.5::DOUBLE - 71 AS ty FROM range(13) r(j))"""
_OVERLAP = """wx AS (SELECT i, ti, least(x + 6, tx + 9.5) - greatest(x - 6, tx - 9.5) AS wx FROM sx, tx WHERE x - 6 < tx + 9.5 AND x + 6 > tx - 9.5),
  wy AS (SELECT j, tj, least(y + 4, ty + 5.25) - greatest(y - 4, ty - 5.25) AS wy FROM sy, ty WHERE y - 4 < ty + 5.25 AND y + 4 > ty - 5.25)"""
_LINEAR = """wx AS (SELECT i, ti, 1 - abs(tx - x) / 12 AS wx FROM sx, tx WHERE abs(tx - x) < 12 AND tx BETWEEN -180 AND 168),
  wy AS (SELECT j, tj, 1 - abs(ty - y) / 8 AS wy FROM sy, ty WHERE abs(ty - y) < 8 AND ty BETWEEN -80 AND 72)"""


def _regrid(spark, d, method):
    x, y = _axes(spark)
    return regrid.regrid2d(masked(spark, d), [], "v", x, y, method).select("j", "i", r6("value").alias("value"))


@query(with_("field masked", f"&{_AXES}, {_OVERLAP} SELECT tj AS j, ti AS i, round(sum(v * wx * wy) / sum(CASE WHEN v IS NOT NULL THEN wx * wy END), 6) AS value FROM masked JOIN wx USING (i) JOIN wy USING (j) GROUP BY 1, 2"))
def regrid2d_average(spark, d):
    return _regrid(spark, d, "average")


@query(with_("field masked", f"&{_AXES}, {_OVERLAP} SELECT tj AS j, ti AS i, round(sum(v * wx * wy / 96), 6) AS value FROM masked JOIN wx USING (i) JOIN wy USING (j) GROUP BY 1, 2"))
def regrid2d_conservative(spark, d):
    return _regrid(spark, d, "conserve")


@query(with_("field masked", f"&{_AXES}, {_LINEAR} SELECT tj AS j, ti AS i, CASE WHEN count(*) = count(v) THEN round(sum(v * wx * wy), 6) END AS value FROM masked JOIN wx USING (i) JOIN wy USING (j) GROUP BY 1, 2"))
def regrid2d_bilinear(spark, d):
    return _regrid(spark, d, "bilinear")


@query(with_("field masked", f"&{_AXES} SELECT tj AS j, ti AS i, round(v, 6) AS value FROM tx, ty, masked WHERE i = CAST(floor((tx + 180) / 12 + 0.5) AS INT) AND j = CAST(floor((ty + 80) / 8 + 0.5) AS INT)"))
def regrid2d_nearest(spark, d):
    return _regrid(spark, d, "nearest")


# a grid with two-dimensional axes

# NJ x NI of them, for every line number and month of lineitem; places hang on the mean quantity
NJ, NI = 7, 12
_GRID = """g AS (SELECT j, i, i + 0.1::DOUBLE * j + 0.01::DOUBLE * i * i + (q - 25) / 1000 AS x, j + 0.05::DOUBLE * i * j AS y FROM (
  SELECT CAST(l_linenumber - 1 AS INT) AS j, CAST(month(l_shipdate) - 1 AS INT) AS i, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2))"""
_C = "j AS j, i AS i, x, y"


def _grid(spark, d):
    cells = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("j"), (F.month("l_shipdate") - 1).cast("int").alias("i")).agg(F.avg("l_quantity").alias("q"))
    return cells.select("j", "i", (F.col("i") + 0.1 * F.col("j") + 0.01 * F.col("i") * F.col("i") + (F.col("q") - 25) / 1000).alias("x"), (F.col("j") + 0.05 * F.col("i") * F.col("j")).alias("y"))


def _edge(v: str) -> str:
    """Corners at the sides: half way between two neighbours on the side, half a step beyond."""
    return f"(1.5::DOUBLE * (a.{v} + b.{v}) - 0.5::DOUBLE * (c.{v} + d.{v})) / 2 AS {v}"


_MESH = f"""{_GRID}, mesh AS (
  SELECT a.j + 1 AS j, a.i + 1 AS i, (a.x + b.x + c.x + d.x) / 4 AS x, (a.y + b.y + c.y + d.y) / 4 AS y FROM g a JOIN g b ON b.j = a.j AND b.i = a.i + 1 JOIN g c ON c.j = a.j + 1 AND c.i = a.i JOIN g d ON d.j = a.j + 1 AND d.i = a.i + 1
  UNION ALL SELECT a.j + 1, CASE WHEN a.i = 0 THEN 0 ELSE {NI} END, {_edge("x")}, {_edge("y")} FROM g a JOIN g b ON b.i = a.i AND b.j = a.j + 1 JOIN g c ON c.j = a.j AND c.i = CASE WHEN a.i = 0 THEN 1 ELSE {NI - 2} END JOIN g d ON d.j = a.j + 1 AND d.i = c.i WHERE a.i IN (0, {NI - 1})
  UNION ALL SELECT CASE WHEN a.j = 0 THEN 0 ELSE {NJ} END, a.i + 1, {_edge("x")}, {_edge("y")} FROM g a JOIN g b ON b.j = a.j AND b.i = a.i + 1 JOIN g c ON c.i = a.i AND c.j = CASE WHEN a.j = 0 THEN 1 ELSE {NJ - 2} END JOIN g d ON d.i = a.i + 1 AND d.j = c.j WHERE a.j IN (0, {NJ - 1})
  UNION ALL SELECT CASE WHEN a.j = 0 THEN 0 ELSE {NJ} END, CASE WHEN a.i = 0 THEN 0 ELSE {NI} END, 1.5::DOUBLE * a.x - 0.5::DOUBLE * b.x, 1.5::DOUBLE * a.y - 0.5::DOUBLE * b.y FROM g a JOIN g b ON b.j = CASE WHEN a.j = 0 THEN 1 ELSE {NJ - 2} END AND b.i = CASE WHEN a.i = 0 THEN 1 ELSE {NI - 2} END WHERE a.j IN (0, {NJ - 1}) AND a.i IN (0, {NI - 1}))"""
_XY = "round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y"


def _xy(df, *columns):
    return df.select(*columns, (r6("x") + 0.0).alias("x"), (r6("y") + 0.0).alias("y"))


@query(f"WITH {_MESH} SELECT j, i, {_XY} FROM mesh")
def mesh_corners(spark, d):
    return _xy(regrid.corners(_grid(spark, d), NJ, NI), "j", "i")


@query(f"WITH {_MESH}, p(n, b, a) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) SELECT g.j, g.i, n, round(m.x, 6) + 0.0::DOUBLE AS x, round(m.y, 6) + 0.0::DOUBLE AS y FROM g, p JOIN mesh m ON m.j = g.j + b AND m.i = g.i + a")
def bounds_of_cells(spark, d):
    return _xy(regrid.cell_bounds2d(regrid.corners(_grid(spark, d), NJ, NI)), "j", "i", "n")


@query(f"WITH {_MESH} SELECT j, i, {_XY} FROM mesh")
def mesh_from_bounds(spark, d):
    return _xy(regrid.mesh_of_bounds(regrid.cell_bounds2d(regrid.corners(_grid(spark, d), NJ, NI))), "j", "i")


@query(f"WITH {_MESH} SELECT g.j, g.i, round(avg(m.x), 6) + 0.0::DOUBLE AS x, round(avg(m.y), 6) + 0.0::DOUBLE AS y FROM g JOIN mesh m ON m.j - g.j IN (0, 1) AND m.i - g.i IN (0, 1) GROUP BY 1, 2")
def centres_of_mesh(spark, d):
    return _xy(regrid.centres(regrid.corners(_grid(spark, d), NJ, NI)), "j", "i")


@query(f"WITH {_GRID} SELECT j, i, round(CASE WHEN i = {NI - 1} THEN x + (x - lag(x) OVER w) / 2 ELSE (x + lead(x) OVER w) / 2 END, 6) AS x, round(CASE WHEN i = {NI - 1} THEN y + (y - lag(y) OVER w) / 2 ELSE (y + lead(y) OVER w) / 2 END, 6) AS y FROM g WINDOW w AS (PARTITION BY j ORDER BY i)")
def shifted_grid(spark, d):
    return _xy(regrid.shift_grid(_grid(spark, d)), "j", "i")


@query(f"""WITH {_GRID}, e AS (SELECT j, i, x, y FROM g UNION ALL SELECT a.j, -CAST(k AS INT), a.x + k * (a.x - b.x), a.y + k * (a.y - b.y) FROM g a JOIN g b ON b.j = a.j AND a.i = 0 AND b.i = 1, range(1, 3) r(k)
  UNION ALL SELECT a.j, {NI - 1} + CAST(k AS INT), a.x + k * (a.x - b.x), a.y + k * (a.y - b.y) FROM g a JOIN g b ON b.j = a.j AND a.i = {NI - 1} AND b.i = {NI - 2}, range(1, 3) r(k)) SELECT j, i, {_XY} FROM e""")
def extended_grid(spark, d):
    return _xy(regrid.extend_grid(_grid(spark, d), NI, 2), "j", "i")


@query(f"""WITH {_GRID}, o AS (SELECT 'itself' AS other, j, i, x, y FROM g UNION ALL SELECT 'moved a little', j, i, x + 1e-9, y FROM g UNION ALL SELECT 'moved', j, i, x, y + 0.1 FROM g UNION ALL SELECT 'smaller', j, i, x, y FROM g WHERE i > 0)
  SELECT other, count(*) = (SELECT count(*) FROM g) AND max(greatest(abs(o.x - g.x), abs(o.y - g.y))) < 1e-6 AS same FROM o JOIN g USING (j, i) GROUP BY 1""")
def same_grids(spark, d):
    g = _grid(spark, d)
    others = {"itself": g, "moved a little": g.withColumn("x", F.col("x") + 1e-9), "moved": g.withColumn("y", F.col("y") + 0.1), "smaller": g.filter("i > 0")}
    out = None
    for name, other in others.items():
        one = regrid.same_grids(g, other).select(F.lit(name).alias("other"), "same")
        out = one if out is None else out.unionByName(one)
    return out


def _field_mesh(spark):
    cells = spark.range(600).select(F.floor(F.col("id") / 30).cast("int").alias("j"), (F.col("id") % 30).cast("int").alias("i"))
    return regrid.corners(cells.withColumns({"x": F.col("i") * 12.0 - 180, "y": F.col("j") * 8.0 - 80}), 20, 30)


@query(f"""WITH {_MESH} SELECT CAST(n AS INT) AS n, {_XY} FROM (
  SELECT i AS n, x, y FROM mesh WHERE j = 0 AND i < {NI} UNION ALL SELECT {NI} + j, x, y FROM mesh WHERE i = {NI} AND j < {NJ}
  UNION ALL SELECT 2 * {NI} + {NJ} - i, x, y FROM mesh WHERE j = {NJ} AND i > 0 UNION ALL SELECT 2 * {NI} + 2 * {NJ} - j, x, y FROM mesh WHERE i = 0 AND j > 0)""")
def grid_envelope(spark, d):
    return _xy(regrid.envelope(regrid.corners(_grid(spark, d), NJ, NI)), "n")


@query(with_("buoys", "SELECT buoy, lon * 1.1::DOUBLE > -186 AND lon * 1.1::DOUBLE < 174 AND lat * 1.1::DOUBLE > -84 AND lat * 1.1::DOUBLE < 76 AS inside FROM buoys"))
def points_in_envelope(spark, d):
    wide = buoys(spark, d).withColumns({"lon": F.col("lon") * 1.1, "lat": F.col("lat") * 1.1})
    return regrid.envelope_mask(wide, _field_mesh(spark), "lon", "lat").select("buoy", "inside")


@query(with_("profiles", "SELECT profile, abs(arg_min(z, level)) > abs(arg_max(z, level)) AS up FROM (SELECT profile, level, CASE WHEN profile % 2 = 0 THEN depth ELSE -120 - depth END AS z FROM profiles) GROUP BY 1"))
def depth_is_up(spark, d):
    p = profiles(spark, d).withColumn("depth", F.when(F.col("profile") % 2 == 0, F.col("depth")).otherwise(-120 - F.col("depth")))
    return regrid.is_depth_up(p, ["profile"], "level", "depth")


@query(with_("profiles", """&z AS (SELECT profile, level, temp, CASE WHEN profile % 2 = 0 THEN depth ELSE -120 - depth END AS z FROM profiles),
  u AS (SELECT profile, abs(arg_min(z, level)) > abs(arg_max(z, level)) AS up, min(level) + max(level) AS ends FROM z GROUP BY 1) SELECT profile, CASE WHEN up THEN level ELSE ends - level END AS level, round(temp, 6) AS temp FROM z JOIN u USING (profile)"""))
def levels_from_the_bottom(spark, d):
    p = profiles(spark, d).withColumn("depth", F.when(F.col("profile") % 2 == 0, F.col("depth")).otherwise(-120 - F.col("depth")))
    return regrid.make_depth_up(p, ["profile"], "level", "depth").select("profile", "level", r6("temp").alias("temp"))


# a sheared grid: x = i + 0.3 j, y = j - 0.2 i; where points lie on it is known

_ON = """p AS (SELECT buoy, (lon + 181.337::DOUBLE) / 14 AS x, (lat + 82.713::DOUBLE) / 9 AS y FROM buoys), r AS (SELECT buoy, (x - 0.3::DOUBLE * y) / 1.06::DOUBLE AS u, y + 0.2::DOUBLE * (x - 0.3::DOUBLE * y) / 1.06::DOUBLE AS v FROM p),
  pos AS (SELECT buoy, CAST(floor(v) AS INT) AS j, CAST(floor(u) AS INT) AS i, u - floor(u) AS p, v - floor(v) AS q FROM r WHERE u >= 0 AND u <= 29 AND v >= 0 AND v <= 19)"""
_CORNERS = "c AS (SELECT buoy, pos.j + b AS j, pos.i + a AS i, abs(1 - a - p) * abs(1 - b - q) AS w, sqrt((p - a) * (p - a) + (q - b) * (q - b)) AS r FROM pos, range(2) x(a), range(2) y(b))"


def _positions(spark, d):
    cells = spark.range(600).select(F.floor(F.col("id") / 30).cast("int").alias("j"), (F.col("id") % 30).cast("int").alias("i"))
    grid = cells.withColumns({"x": F.col("i") + 0.3 * F.col("j"), "y": F.col("j") - 0.2 * F.col("i")})
    at = buoys(spark, d).select("buoy", ((F.col("lon") + 181.337) / 14).alias("x"), ((F.col("lat") + 82.713) / 9).alias("y"))
    return sections.relative_positions(grid, at, "buoy", 1.5)


@query(with_("buoys", f"&{_ON} SELECT buoy, j, i, round(p, 6) AS p, round(q, 6) AS q FROM pos"))
def positions_on_curved_grid(spark, d):
    return _positions(spark, d).select("buoy", "j", "i", r6("p").alias("p"), r6("q").alias("q"))


@query(with_("field masked buoys", f"&{_ON}, {_CORNERS} SELECT buoy, CASE WHEN count(*) = count(m.v) THEN round(sum(m.v * w), 6) END AS value FROM c LEFT JOIN masked m USING (j, i) WHERE w > 1e-12 GROUP BY 1"))
def curved_bilinear(spark, d):
    return sections.apply_positions(masked(spark, d), _positions(spark, d), "buoy", "v").select("buoy", r6("value").alias("value"))


@query(with_("field masked buoys", f"&{_ON} SELECT buoy, round(m.v, 6) AS value FROM (SELECT buoy, j + CAST(q >= 0.5 AS INT) AS j, i + CAST(p >= 0.5 AS INT) AS i FROM pos) a LEFT JOIN masked m USING (j, i)"))
def curved_nearest(spark, d):
    return sections.apply_positions(masked(spark, d), _positions(spark, d), "buoy", "v", "nearest").select("buoy", r6("value").alias("value"))


@query(with_("field masked buoys", f"&{_ON}, {_CORNERS} SELECT buoy, round(sum(m.v / greatest(r, 1e-12)) / sum(CASE WHEN m.v IS NOT NULL THEN 1 / greatest(r, 1e-12) END), 6) AS value FROM c LEFT JOIN masked m USING (j, i) GROUP BY 1"))
def curved_distance_weights(spark, d):
    return sections.apply_positions(masked(spark, d), _positions(spark, d), "buoy", "v", "dstwgt").select("buoy", r6("value").alias("value"))


# four axes

_F4 = "f4 AS (SELECT CAST(l_linenumber - 1 AS INT) AS i_x, CAST(l_partkey % 5 AS INT) AS i_y, CAST(l_suppkey % 6 AS INT) AS i_z, CAST(month(l_shipdate) % 4 AS INT) AS i_t, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"
_P4 = "p4 AS (SELECT c_custkey AS id, (c_custkey * 7 % 73) / 10.0::DOUBLE AS x, (c_custkey * 11 % 47) / 10.0::DOUBLE AS y, (c_custkey * 13 % 59) / 10.0::DOUBLE AS z, (c_custkey * 17 % 37) / 10.0::DOUBLE AS t FROM customer)"


def _four(spark, d, method):
    li = table(spark, d, "lineitem")
    f = li.groupBy(
        (F.col("l_linenumber") - 1).cast("int").alias("i_x"), (F.col("l_partkey") % 5).cast("int").alias("i_y"), (F.col("l_suppkey") % 6).cast("int").alias("i_z"), (F.month("l_shipdate") % 4).cast("int").alias("i_t")
    ).agg(F.avg("l_quantity").alias("v"))
    c = F.col("c_custkey")
    p = table(spark, d, "customer").select(c.alias("id"), *[((c * k % m) / 10.0).alias(a) for a, k, m in (("x", 7, 73), ("y", 11, 47), ("z", 13, 59), ("t", 17, 37))])
    return sections.at_points_4d(f, p, "v", {a: (0.0, 1.0) for a in "xyzt"}, method).select("id", r6("value").alias("value"))


@query(f"""WITH {_F4}, {_P4}, c AS (SELECT id, CAST(floor(x) AS INT) + a AS i_x, CAST(floor(y) AS INT) + b AS i_y, CAST(floor(z) AS INT) + c AS i_z, CAST(floor(t) AS INT) + e AS i_t,
  abs(1 - a - (x - floor(x))) * abs(1 - b - (y - floor(y))) * abs(1 - c - (z - floor(z))) * abs(1 - e - (t - floor(t))) AS w FROM p4, range(2) q(a), range(2) r(b), range(2) s(c), range(2) u(e))
  SELECT id, CASE WHEN count(*) = count(v) THEN round(sum(v * w), 6) END AS value FROM c LEFT JOIN f4 USING (i_x, i_y, i_z, i_t) WHERE w > 0 GROUP BY 1""")
def linear_in_four_axes(spark, d):
    return _four(spark, d, "linear")


@query(f"WITH {_F4}, {_P4} SELECT id, round(v, 6) AS value FROM p4 LEFT JOIN f4 ON i_x = CAST(floor(x + 0.5) AS INT) AND i_y = CAST(floor(y + 0.5) AS INT) AND i_z = CAST(floor(z + 0.5) AS INT) AND i_t = CAST(floor(t + 0.5) AS INT)")
def nearest_in_four_axes(spark, d):
    return _four(spark, d, "nearest")


# scattered points: stations, moved a little so that no four lie on a circle; triangles by their empty circles

_MOVED = "s AS (SELECT station AS k, lon + sin(station * 1.7::DOUBLE) AS x, lat + cos(station * 2.3::DOUBLE) AS y, z::DOUBLE AS z FROM stations)"
_TRIANGLES = f"""{_MOVED}, t AS (SELECT a.k AS ka, b.k AS kb, c.k AS kc, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz,
    (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS det FROM s a JOIN s b ON a.k < b.k JOIN s c ON b.k < c.k),
  o AS (SELECT *, ((cy - ay) * (pow(bx - ax, 2) + pow(by_ - ay, 2)) - (by_ - ay) * (pow(cx - ax, 2) + pow(cy - ay, 2))) / (2 * det) AS ux, ((bx - ax) * (pow(cx - ax, 2) + pow(cy - ay, 2)) - (cx - ax) * (pow(bx - ax, 2) + pow(by_ - ay, 2))) / (2 * det) AS uy FROM t WHERE det <> 0),
  tri AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k NOT IN (o.ka, o.kb, o.kc) AND pow(s.x - o.ax - o.ux, 2) + pow(s.y - o.ay - o.uy, 2) < (pow(o.ux, 2) + pow(o.uy, 2)) * (1 - 1e-12)))"""


def _moved(spark, d):
    k = F.col("station")
    return stations(spark, d).select(k.alias("k"), (F.col("lon") + F.sin(k * 1.7)).alias("x"), (F.col("lat") + F.cos(k * 2.3)).alias("y"), F.col("z").cast("double").alias("z"))


@query(with_("stations buoys", f"""&{_TRIANGLES}, q AS (SELECT buoy, lon * 0.97::DOUBLE + 0.123::DOUBLE AS x, lat * 0.97::DOUBLE + 0.321::DOUBLE AS y FROM buoys),
  h AS (SELECT buoy, az, bz, cz, ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / det AS u, ((bx - ax) * (y - ay) - (x - ax) * (by_ - ay)) / det AS w FROM q, tri),
  f AS (SELECT buoy, any_value(az * (1 - u - w) + bz * u + cz * w) AS value FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1 GROUP BY 1) SELECT buoy, round(value, 4) AS value FROM q LEFT JOIN f USING (buoy)"""))
def scattered_linear(spark, d):
    at = buoys(spark, d).select("buoy", (F.col("lon") * 0.97 + 0.123).alias("x"), (F.col("lat") * 0.97 + 0.321).alias("y"))
    return scatter.linear(_moved(spark, d), at, "buoy").select("buoy", F.round("value", 4).alias("value"))


@query(with_("stations", f"""&{_TRIANGLES}, q AS (SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, i * 30.0::DOUBLE - 165.37::DOUBLE AS x, j * 20.0::DOUBLE - 70.91::DOUBLE AS y FROM range(8) a(j), range(12) b(i)),
  h AS (SELECT j, i, az, bz, cz, ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / det AS u, ((bx - ax) * (y - ay) - (x - ax) * (by_ - ay)) / det AS w FROM q, tri),
  f AS (SELECT j, i, any_value(az * (1 - u - w) + bz * u + cz * w) AS value FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1 GROUP BY 1, 2) SELECT j, i, round(value, 4) AS value FROM q LEFT JOIN f USING (j, i)"""))
def scattered_to_grid(spark, d):
    cells = spark.range(96).select(F.floor(F.col("id") / 12).cast("int").alias("j"), (F.col("id") % 12).cast("int").alias("i"))
    grid = cells.withColumns({"x": F.col("i") * 30.0 - 165.37, "y": F.col("j") * 20.0 - 70.91})
    return scatter.to_grid(_moved(spark, d), grid, 30.0).select("j", "i", F.round("value", 4).alias("value"))


@query(with_("stations buoys", f"""&{_TRIANGLES}, q AS (SELECT buoy, lon * 0.97::DOUBLE + 0.123::DOUBLE AS x, lat * 0.97::DOUBLE + 0.321::DOUBLE AS y, v FROM buoys),
  h AS (SELECT buoy, ((x - ax) * (cy - ay) - (cx - ax) * (y - ay)) / det AS u, ((bx - ax) * (y - ay) - (x - ax) * (by_ - ay)) / det AS w FROM q, tri)
  SELECT 'buoys' AS id, round(x, 6) AS x, round(y, 6) AS y, round(v, 2) AS z FROM q WHERE buoy NOT IN (SELECT buoy FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1) UNION ALL SELECT 'stations', round(x, 6), round(y, 6), round(z, 2) FROM s"""))
def bank_merged_opaque(spark, d):
    """Two sets of soundings, of which the upper one hides what lies in its hull."""
    from halocline.operators.cut import Steps
    from halocline.sources.bank import Bank

    bank = Bank(spark, Steps(spark, "bank").root)
    bank.add(buoys(spark, d).select((F.col("lon") * 0.97 + 0.123).alias("x"), (F.col("lat") * 0.97 + 0.321).alias("y"), F.col("v").cast("double").alias("z")), "buoys")
    bank.add(_moved(spark, d).select("x", "y", "z"), "stations")
    found = bank.merged(["buoys", "stations"], opaque=["stations"])
    return found.select("id", r6("x").alias("x"), r6("y").alias("y"), F.round("z", 2).alias("z"))


@query(with_("stations buoys", f"&{_MOVED}, n AS (SELECT buoy, z, row_number() OVER (PARTITION BY buoy ORDER BY sqrt(pow(s.x - b.lon, 2) + pow(s.y - b.lat, 2)), k) AS n FROM buoys b, s) SELECT buoy, round(z, 6) AS value FROM n WHERE n = 1"))
def scattered_nearest(spark, d):
    at = buoys(spark, d).select("buoy", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return scatter.nearest_value(_moved(spark, d), "k", at, "buoy", 15.0).select("buoy", r6("value").alias("value"))


@query(with_("stations", f"&{_MOVED} SELECT CAST(j AS INT) AS j, CAST(i AS INT) AS i, round(lox + i * 25, 6) AS x, round(loy + j * 25, 6) AS y FROM (SELECT min(x) AS lox, max(x) AS hix, min(y) AS loy, max(y) AS hiy FROM s), range(100) a(j), range(100) b(i) WHERE j <= ceil((hiy - loy) / 25) AND i <= ceil((hix - lox) / 25)"))
def grid_over_points(spark, d):
    return _xy(scatter.grid_over(_moved(spark, d), 25.0), "j", "i")


@query(with_("field masked", "SELECT j, i, CASE WHEN v IS NOT NULL OR (i > 0 AND i < 29 AND j > 0 AND j < 19) THEN round(2.0::DOUBLE * j + 3 * i, 6) END AS v FROM masked WHERE v IS NOT NULL OR (i > 0 AND i < 29 AND j > 0 AND j < 19)"))
def filled_plane(spark, d):
    """Holes of a plane, filled on triangles; those at the edge may lie beyond the hull and are left out here."""
    plane = masked(spark, d).withColumn("v", F.when(F.col("v").isNotNull(), 2.0 * F.col("j") + 3 * F.col("i")))
    filled = scatter.fill2d(plane, "v").select("j", "i", r6("v").alias("v"))
    edge = F.col("i").isin(0, 29) | F.col("j").isin(0, 19)
    holes = plane.filter("v is null").select("j", "i").filter(edge)
    return filled.join(holes, ["j", "i"], "left_anti")


@query(with_("field masked", "&n AS (SELECT a.j, a.i, b.v, row_number() OVER (PARTITION BY a.j, a.i ORDER BY sqrt(pow(a.j - b.j, 2) + pow(a.i - b.i, 2)), b.j, b.i) AS n FROM masked a, masked b WHERE a.v IS NULL AND b.v IS NOT NULL) SELECT j, i, round(coalesce(m.v, n.v), 6) AS v FROM masked m LEFT JOIN (SELECT * FROM n WHERE n = 1) n USING (j, i)"))
def filled_with_nearest(spark, d):
    return scatter.fill2d(masked(spark, d), "v", method="nearest").select("j", "i", r6("v").alias("v"))


# polygons: boxes, of which the share of a cell is a product of lengths

_BOXES = [(-101.3, -41.7, 48.9, 29.3), (52.1, -41.7, 133.7, 29.3)]


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def _share(x0, y0, x1, y1) -> str:
    return f"greatest(0, least(x + 6, {x1}) - greatest(x - 6, {x0})) * greatest(0, least(y + 4, {y1}) - greatest(y - 4, {y0})) / 96.0::DOUBLE"


_PARTS = f"m AS (SELECT j, i, v, i * 12.0::DOUBLE - 180 AS x, j * 8.0::DOUBLE - 80 AS y FROM masked), a AS (SELECT *, {_share(*_BOXES[0])} AS s1, {_share(*_BOXES[1])} AS s2 FROM m)"


def _cells(spark, d):
    return masked(spark, d).select("j", "i", "v", (F.col("i") * 12.0 - 180).alias("lon"), (F.col("j") * 8.0 - 80).alias("lat"))


@query(with_("field masked", f"&{_PARTS} SELECT j, i, s1 + s2 >= CASE WHEN s1 > 0 AND s2 > 0 THEN 0.75 ELSE 0.5 END AS mask FROM a"))
def polygon_mask_by_area(spark, d):
    return points.polygon_mask(_cells(spark, d), [_box(*b) for b in _BOXES], 12.0, 8.0).select("j", "i", "mask")


@query(with_("field masked", f"&{_PARTS} SELECT j, i, " + " OR ".join(f"(x >= {a} AND x < {c} AND y >= {b} AND y < {e})" for a, b, c, e in _BOXES) + " AS mask FROM a"))
def polygon_mask_by_centre(spark, d):
    return points.polygon_mask(_cells(spark, d), [_box(*b) for b in _BOXES], 12.0, 8.0, "inside").select("j", "i", "mask")


@query(with_("field masked", f"&{_PARTS} SELECT j, i, CASE WHEN s1 + s2 <= 0.75 AND s1 > 0 AND s2 > 0 THEN false ELSE true END AS mask FROM a"))
def opened_straits(spark, d):
    cells = _cells(spark, d).withColumns({"coastal": F.lit(True), "mask": F.lit(True)})
    return points.open_straits(cells, "coastal", [_box(*b) for b in _BOXES], 12.0, 8.0).select("j", "i", "mask")


@query(with_("field masked", """SELECT j, i, (i = 10 AND j = 10) OR (i = 20 AND j = 5) AS mask FROM masked"""))
def covered_islands(spark, d):
    """Islands as large as a cell, mostly in one; smaller and larger ones do not count."""
    around = lambda x, y, w, h: _box(x - w / 2, y - h / 2, x + w / 2, y + h / 2)
    shapes = [around(-59.0, 0.5, 11.8, 8.2), around(61.0, -41.0, 12.3, 8.8), around(0.0, 0.0, 3.0, 2.0), around(100.0, 40.0, 60.0, 30.0)]
    islands = spark.createDataFrame([([{"x": x, "y": y} for x, y in s],) for s in shapes], "shape array<struct<x:double,y:double>>")
    mask = _cells(spark, d).withColumn("mask", F.lit(False))
    return points.cover_islands(mask, islands, 12.0, 8.0).select("j", "i", "mask")



