"""Queries: gridded fields, masks, physics, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.functions import geo, seawater, units
from halocline.operators import grid, profiles as prof, sections, select
from halocline.operators.points import nearest
from halocline.plans.inputs import buoys, field, masked, profiles, r6, stations, with_
from halocline.plans.registry import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


def _filter2d_sql(weights: list[list[float]], mask: str) -> str:
    rows = ", ".join(f"({j - len(weights) // 2}, {i - len(weights[0]) // 2}, {w!r}::DOUBLE)" for j, row in enumerate(weights) for i, w in enumerate(row) if w)
    value = {"same": "CASE WHEN max(CASE WHEN dj = 0 AND di = 0 THEN n.v END) IS NOT NULL THEN {x} END", "minimal": "{x}"}[mask].format(x="round(sum(n.v * w) / sum(CASE WHEN n.v IS NOT NULL THEN w END), 6)")
    return with_("field masked", f"&k(dj, di, w) AS (VALUES {rows}) SELECT m.j, m.i, {value} AS filtered FROM masked m, k JOIN masked n ON n.j = m.j + dj AND n.i = m.i + di GROUP BY 1, 2")


# The weights as they should be, for the SQL alone.
_SHAPIRO = [[0.5, 1.0, 0.5], [1.0, 2.0, 1.0], [0.5, 1.0, 0.5]]
_FAR, _DIAGONAL, _SIDE = 0.000123409804087, 0.011108996538242, 0.105399224561864
_GAUSSIAN = [
    [0.0, 0.0, _FAR, 0.0, 0.0],
    [0.0, _DIAGONAL, _SIDE, _DIAGONAL, 0.0],
    [_FAR, _SIDE, 1.0, _SIDE, _FAR],
    [0.0, _DIAGONAL, _SIDE, _DIAGONAL, 0.0],
    [0.0, 0.0, _FAR, 0.0, 0.0],
]


@query(_filter2d_sql(_SHAPIRO, "same"))
def filter2d_shapiro(spark, d):
    return grid.filter2d(masked(spark, d), [], "v", grid.shapiro2d()).select("j", "i", r6("filtered").alias("filtered"))


@query(_filter2d_sql(_GAUSSIAN, "minimal"))
def filter2d_gaussian(spark, d):
    return grid.filter2d(masked(spark, d), [], "v", grid.gaussian2d(5), "minimal").select("j", "i", r6("filtered").alias("filtered"))


# the field covers lon -180 .. 168 (12 degrees a cell) and lat -80 .. 72 (8 degrees a cell)
_PX, _PY = "(lon + 180) / 12.0::DOUBLE", "(lat + 80) / 8.0::DOUBLE"


@query(with_("stations field masked", f"""&p AS (SELECT station, {_PX} AS x, {_PY} AS y FROM stations), c AS (SELECT station, CAST(floor(y) AS INT) + b AS j, CAST(floor(x) AS INT) + a AS i,
  abs(1 - a - (x - floor(x))) * abs(1 - b - (y - floor(y))) AS w FROM p, range(2) r(a), range(2) q(b))
  SELECT station, CASE WHEN count(*) = count(v) THEN round(sum(w * v), 6) END AS value FROM c LEFT JOIN masked USING (j, i) WHERE w > 0 GROUP BY 1"""))
def bilinear_at_stations(spark, d):
    points = stations(spark, d).select("station", "lon", "lat")
    return grid.at_points(masked(spark, d), points, [], "v", -180.0, 12.0, -80.0, 8.0, "bilinear", "lon", "lat").select("station", r6("value").alias("value"))


@query(with_("stations field masked", f"""&p AS (SELECT station, {_PX} AS x, {_PY} AS y FROM stations), c AS (SELECT station, CAST(floor(y) AS INT) + b AS j, CAST(floor(x) AS INT) + a AS i,
  greatest(sqrt((x - floor(x) - a) * (x - floor(x) - a) + (y - floor(y) - b) * (y - floor(y) - b)), 1e-12) AS r FROM p, range(2) r(a), range(2) q(b))
  SELECT station, round(sum(v / r) / sum(CASE WHEN v IS NOT NULL THEN 1 / r END), 6) AS value FROM c LEFT JOIN masked USING (j, i) GROUP BY 1"""))
def distance_weights_at_stations(spark, d):
    points = stations(spark, d).select("station", "lon", "lat")
    return grid.at_points(masked(spark, d), points, [], "v", -180.0, 12.0, -80.0, 8.0, "dstwgt", "lon", "lat").select("station", r6("value").alias("value"))


@query(with_("stations field masked", f"SELECT station, round(v, 6) AS value FROM stations LEFT JOIN masked ON j = CAST(floor({_PY} + 0.5) AS INT) AND i = CAST(floor({_PX} + 0.5) AS INT)"))
def nearest_cell_at_stations(spark, d):
    points = stations(spark, d).select("station", "lon", "lat")
    return grid.at_points(masked(spark, d), points, [], "v", -180.0, 12.0, -80.0, 8.0, "nearest", "lon", "lat").select("station", r6("value").alias("value"))


@query(with_("field masked", "SELECT CAST(floor(j / 4) AS INT) AS j, CAST(floor(i / 5) AS INT) AS i, round(avg(v), 6) AS value FROM masked GROUP BY 1, 2"))
def regrid_average(spark, d):
    return grid.regrid_average(masked(spark, d), [], "v", 4, 5).select("j", "i", r6("value").alias("value"))


@query(with_("field masked", """&c AS (SELECT * FROM masked UNION ALL SELECT j, i - 30, v FROM masked WHERE i >= 28 UNION ALL SELECT j, i + 30, v FROM masked WHERE i < 2) SELECT j, CAST(i AS INT) AS i, round(v, 6) AS value FROM c"""))
def extend_cyclic(spark, d):
    return grid.extend(masked(spark, d), [], "v", 2, 30, "cyclic").select("j", "i", r6("value").alias("value"))


@query(with_("field", """&e AS (SELECT j, max(CASE WHEN i = 0 THEN v END) AS a, max(CASE WHEN i = 1 THEN v END) AS b, max(CASE WHEN i = 28 THEN v END) AS y, max(CASE WHEN i = 29 THEN v END) AS z FROM field GROUP BY 1),
  g AS (SELECT j, -1 AS i, a + (a - b) AS v FROM e UNION ALL SELECT j, -2, a + 2 * (a - b) FROM e UNION ALL SELECT j, 30, z + (z - y) FROM e UNION ALL SELECT j, 31, z + 2 * (z - y) FROM e UNION ALL SELECT j, i, v FROM field)
  SELECT j, CAST(i AS INT) AS i, round(v, 6) AS value FROM g"""))
def extend_extrapolated(spark, d):
    return grid.extend(field(spark, d), [], "v", 2, 30, "extrap").select("j", "i", r6("value").alias("value"))


@query(with_("field", "SELECT j, CAST((i - 7 + 30) % 30 AS INT) AS i, round(v, 6) AS v FROM field"))
def shift_columns(spark, d):
    return grid.shift_columns(field(spark, d), 7, 30).select("j", "i", r6("v").alias("v"))


@query(with_("field", """&x AS (SELECT j, i, CASE WHEN lead(v) OVER w IS NULL THEN v + (v - lag(v) OVER w) / 2 ELSE (v + lead(v) OVER w) / 2 END AS v FROM field WINDOW w AS (PARTITION BY j ORDER BY i))
  SELECT j, i, round(CASE WHEN lead(v) OVER w IS NULL THEN v + (v - lag(v) OVER w) / 2 ELSE (v + lead(v) OVER w) / 2 END, 6) AS v FROM x WINDOW w AS (PARTITION BY i ORDER BY j)"""))
def to_corner_points(spark, d):
    return grid.to_location(field(spark, d), [], "v", "f").select("j", "i", r6("v").alias("v"))


@query(with_("field masked", """&l AS (SELECT j, i, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS l FROM masked),
  s(dj, di, w) AS (VALUES (1, 0, 4), (0, -1, 8), (0, 1, 2), (-1, 0, 1)), c(dj, di, w) AS (VALUES (1, -1, 128), (1, 1, 64), (-1, -1, 16), (-1, 1, 32)),
  a AS (SELECT m.j, m.i, sum(n.l * w) AS side FROM l m, s JOIN l n ON n.j = m.j + dj AND n.i = m.i + di GROUP BY 1, 2), b AS (SELECT m.j, m.i, sum(n.l * w) AS corner FROM l m, c JOIN l n ON n.j = m.j + dj AND n.i = m.i + di GROUP BY 1, 2)
  SELECT j, i, CAST(CASE WHEN l = 1 THEN 0 WHEN side > 0 THEN side ELSE corner END AS INT) AS code FROM l JOIN a USING (j, i) JOIN b USING (j, i)"""))
def coast_code(spark, d):
    return grid.coast(masked(spark, d), [], F.col("v").isNull())


@query(with_("field", f"""&p AS (SELECT j, i, {units.GRAVITY!r}::DOUBLE / (2 * sin(radians(20 + j)) * (2 * pi() / 86164)) * v / 100 AS p FROM field),
  g AS (SELECT j, i, -(lead(p) OVER (PARTITION BY i ORDER BY j) - p) / 100000 AS u, (lead(p) OVER (PARTITION BY j ORDER BY i) - p) / 100000 AS v FROM p)
  SELECT j, i, round(u, 6) AS u, round(v, 6) AS v FROM g"""))
def geostrophic_velocity(spark, d):
    f = field(spark, d).withColumn("v", F.col("v") / 100)
    return grid.geostrophy(f, [], "v", (20 + F.col("j")).cast("double"), 1e5, 1e5).select("j", "i", r6("u").alias("u"), r6("v").alias("v"))


@query(with_("field", f"""&p AS (SELECT j, i, {units.GRAVITY!r}::DOUBLE / (2 * sin(radians(20 + j)) * (2 * pi() / 86164)) * v / 100 AS p FROM field),
  g AS (SELECT j, i, -(lead(p) OVER (PARTITION BY i ORDER BY j) - p) / 100000 AS u, (lead(p) OVER (PARTITION BY j ORDER BY i) - p) / 100000 AS v FROM p),
  b AS (SELECT *, lag(u) OVER (PARTITION BY i ORDER BY j) AS bu, lag(v) OVER (PARTITION BY j ORDER BY i) AS bv FROM g)
  SELECT j, i, round(((coalesce(u * u, 0) + coalesce(bu * bu, 0)) / (CAST(u IS NOT NULL AS INT) + CAST(bu IS NOT NULL AS INT)) + (coalesce(v * v, 0) + coalesce(bv * bv, 0)) / (CAST(v IS NOT NULL AS INT) + CAST(bv IS NOT NULL AS INT))) / 2, 6) AS ke FROM b"""))
def kinetic_energy(spark, d):
    f = field(spark, d).withColumn("v", F.col("v") / 100)
    uv = grid.geostrophy(f, [], "v", (20 + F.col("j")).cast("double"), 1e5, 1e5)
    return grid.kinetic_energy(uv, []).select("j", "i", r6("ke").alias("ke"))


@query(with_("field", f"SELECT j, i, round(96.0::DOUBLE * {(3.141592653589793 * units.EARTH_RADIUS / 180) ** 2!r}::DOUBLE * cos(radians(-80 + j * 8.0::DOUBLE)) / 1e9, 6) AS area FROM field"))
def cell_areas(spark, d):
    return field(spark, d).select("j", "i", r6(grid.cell_area(-80 + F.col("j") * 8.0, 12.0, 8.0) / 1e9).alias("area"))


@query("SELECT true AS rectangular")
def rectangular_grid(spark, d):
    g = field(spark, d).select("j", "i", (F.col("i") * 12.0 - 180).alias("lon"), (F.col("j") * 8.0 - 80).alias("lat"))
    return grid.is_rectangular(g)


# physics


def _poly(cs: list[float], t: str) -> str:
    return "(" + " + ".join(f"{c!r}::DOUBLE * pow({t}, {k})" for k, c in enumerate(cs)) + ")"


_RHO0 = f"({_poly(seawater.RHO_W, 'temp')} + {_poly(seawater.RHO_S, 'temp')} * sal + {_poly(seawater.RHO_S32, 'temp')} * pow(sal, 1.5) + {seawater.RHO_S2!r}::DOUBLE * sal * sal)"
_K0 = f"({_poly(seawater.K_W, 'temp')} + {_poly(seawater.K_S, 'temp')} * sal + {_poly(seawater.K_S32, 'temp')} * pow(sal, 1.5))"
_A = f"({_poly(seawater.A_W, 'temp')} + {_poly(seawater.A_S, 'temp')} * sal + {seawater.A_S32!r}::DOUBLE * pow(sal, 1.5))"
_B = f"({_poly(seawater.B_W, 'temp')} + {_poly(seawater.B_S, 'temp')} * sal)"
_C = "(5.92e-3::DOUBLE + 5.25e-3::DOUBLE * pow(sin(radians(45)), 2))"
_P = f"(((1 - {_C}) - sqrt((1 - {_C}) * (1 - {_C}) - 8.84e-6::DOUBLE * -depth)) / 4.42e-6::DOUBLE / 10)"


@query(with_("profiles", f"SELECT profile, level, round({_RHO0}, 6) AS potential, round({_RHO0} / (1 - {_P} / ({_K0} + {_A} * {_P} + {_B} * {_P} * {_P})), 6) AS dens FROM profiles"))
def sea_water_density(spark, d):
    p = profiles(spark, d)
    dens = seawater.density(F.col("temp"), F.col("sal"), -F.col("depth"), F.lit(45.0))
    return p.select("profile", "level", r6(seawater.density(F.col("temp"), F.col("sal"))).alias("potential"), r6(dens).alias("dens"))


def _mld_sql(value: str, delta: float) -> str:
    hit = "x > 0 AND nx <= 0" if delta < 0 else "x < 0 AND nx >= 0"
    return with_("profiles", f"""&d AS (SELECT profile, depth, {value} AS v FROM profiles), f AS (SELECT *, v - first_value(v) OVER (PARTITION BY profile ORDER BY depth DESC) - {delta!r}::DOUBLE AS x FROM d),
  n AS (SELECT *, lead(x) OVER (PARTITION BY profile ORDER BY depth DESC) AS nx, lead(depth) OVER (PARTITION BY profile ORDER BY depth DESC) AS nz FROM f)
  SELECT profile, round(-coalesce(max(CASE WHEN {hit} THEN depth + (nz - depth) * x / (x - nx) END), min(depth)), 6) AS mld FROM n GROUP BY 1""")


@query(_mld_sql("temp", -0.2))
def mixed_layer_by_temperature(spark, d):
    return prof.mixed_layer(profiles(spark, d), ["profile"], "depth", "temp", -0.2).select("profile", r6("mld").alias("mld"))


@query(_mld_sql(_RHO0, 0.03))
def mixed_layer_by_density(spark, d):
    p = prof.with_density(profiles(spark, d), "temp", "sal")
    return prof.mixed_layer(p, ["profile"], "depth", "dens", 0.03).select("profile", r6("mld").alias("mld"))


@query(with_("profiles", "SELECT profile, round(-coalesce(max(CASE WHEN temp / 1000 <= 0.005::DOUBLE THEN depth END), min(depth)), 6) AS mld FROM profiles GROUP BY 1"))
def mixed_layer_by_diffusivity(spark, d):
    p = profiles(spark, d).withColumn("kz", F.col("temp") / 1000)
    return prof.diffusive_layer(p, ["profile"], "depth", "kz", 0.005).select("profile", r6("mld").alias("mld"))


_THICK = f"""&d AS (SELECT profile, depth, {_RHO0} AS v, lag(depth) OVER w AS b, lead(depth) OVER w AS a FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY depth DESC)),
  t AS (SELECT profile, v, coalesce((b - depth) / 2, -depth) + coalesce((depth - a) / 2, 0) AS dz FROM d),
  m AS (SELECT profile, sum(v * dz) / sum(dz) AS mean, sum(dz) AS h, min(v) AS lo, max(v) AS hi FROM t GROUP BY 1)"""


@query(with_("profiles", f"{_THICK} SELECT profile, round(lo, 5) AS dens_min, round(hi, 5) AS dens_max, round(mean, 5) AS dens_mean, round(h, 5) AS height, CASE WHEN hi > lo THEN round(h * (hi - mean) / (hi - lo), 5) END AS two_layer FROM m"))
def stratification(spark, d):
    p = prof.with_density(profiles(spark, d), "temp", "sal")
    found = prof.stratification(p, ["profile"], "depth", "dens")
    return found.select("profile", *[F.round(c, 5).alias(c) for c in ("dens_min", "dens_max", "dens_mean", "height", "two_layer")])


@query(with_("profiles", f"{_THICK} SELECT profile, round(sum({units.GRAVITY!r}::DOUBLE * (v - mean) * dz * dz / h), 4) + 0.0::DOUBLE AS ped FROM t JOIN m USING (profile) GROUP BY 1"))
def potential_energy_deficit(spark, d):
    p = prof.with_density(profiles(spark, d), "temp", "sal")
    return prof.energy_deficit(p, ["profile"], "depth", "dens").select("profile", (F.round("ped", 4) + 0.0).alias("ped"))


@query(with_("buoys", "SELECT buoy, round(0.016 * 1.25 * sqrt(lon * lon + lat * lat) * lon, 6) + 0.0::DOUBLE AS tx, round(0.016 * 1.25 * sqrt(lon * lon + lat * lat) * lat, 6) + 0.0::DOUBLE AS ty, round(lon, 6) + 0.0::DOUBLE AS u, round(lat, 6) + 0.0::DOUBLE AS v FROM buoys"))
def wind_stress_and_back(spark, d):
    b = buoys(spark, d)
    tx, ty = seawater.wind_stress(F.col("lon"), F.col("lat"))
    u, v = seawater.wind_from_stress(tx, ty)
    return b.select("buoy", *[(r6(c) + 0.0).alias(n) for n, c in (("tx", tx), ("ty", ty), ("u", u), ("v", v))])


_S = "(-level / 8.0::DOUBLE)"


@query(with_("profiles", f"""SELECT profile, level, round({_S} * (0.5 + temp * 100) + 0.5, 6) AS standard, round({_S} * (0.5 + temp * 100) - temp * 100, 6) AS ocean,
  round(0.5 * (1 + {_S}) + 10 * {_S} + (temp * 100 - 10) * ((1 - 0.4::DOUBLE) * (exp(3 * {_S}) - exp(-3 * {_S})) / 2 / {10.017874927409903!r}::DOUBLE
  + 0.4::DOUBLE * ((1 - 2 / (exp(6 * ({_S} + 0.5)) + 1)) / (2 * {0.9051482536448664!r}::DOUBLE) - 0.5)), 6) AS general FROM profiles"""))
def sigma_depths(spark, d):
    s, bottom, eta = -F.col("level") / 8.0, F.col("temp") * 100, F.lit(0.5)
    return profiles(spark, d).select(
        "profile", "level", r6(seawater.sigma_depth(s, bottom, eta)).alias("standard"), r6(seawater.sigma_depth(s, bottom, eta, "ocean")).alias("ocean"),
        r6(seawater.generalized_depth(s, bottom, eta, 10.0, 3.0, 0.4)).alias("general"),
    )


_NAMES = "['" + "', '".join(units.COMPASS) + "']"


@query(with_("buoys", f"""SELECT buoy, round(v * 0.514444::DOUBLE, 6) AS ms, round(v - 273.15::DOUBLE, 6) AS degc, round(sqrt(lon * lon + lat * lat), 6) AS mod,
  round((degrees(atan2(lat, lon)) + 360) % 360, 6) AS angle, {_NAMES}[CAST((CAST(floor((lon + 180 + 11.25) / 22.5) AS BIGINT) % 16) + 1 AS INT)] AS point, round(lon * {3.141592653589793 * units.EARTH_RADIUS / 180!r}::DOUBLE * cos(radians(lat)), 3) + 0.0::DOUBLE AS metres,
  CAST(round(pow(pow(abs(lat) * 3.6, 2) / 9, 1.0 / 3)) AS INT) AS force FROM buoys"""))
def unit_functions(spark, d):
    v, lon, lat = F.col("v"), F.col("lon"), F.col("lat")
    return buoys(spark, d).select(
        "buoy", r6(units.kt2ms(v)).alias("ms"), r6(units.kel2degc(v)).alias("degc"), r6(units.modulus(lon, lat)).alias("mod"), r6(units.direction(lon, lat)).alias("angle"),
        units.compass(lon + 180).alias("point"), (F.round(units.deg2m(lon, lat), 3) + 0.0).alias("metres"), units.ms2bf(F.abs(lat)).alias("force"),
    )


@query(with_("buoys", f"SELECT buoy, round(radians(lon) * {units.EARTH_RADIUS!r}::DOUBLE, 3) + 0.0::DOUBLE AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * {units.EARTH_RADIUS!r}::DOUBLE, 3) + 0.0::DOUBLE AS y FROM buoys"))
def mercator(spark, d):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return buoys(spark, d).select("buoy", (F.round(x, 3) + 0.0).alias("x"), (F.round(y, 3) + 0.0).alias("y"))



# sections, selections, merged fields

_N, _A, _B = 40, (-100.0, -30.0), (120.0, 50.0)
_P = "cos(radians({0[1]})) * cos(radians({0[0]}))", "cos(radians({0[1]})) * sin(radians({0[0]}))", "sin(radians({0[1]}))"
_DOT = " + ".join(f"({p.format(_A)}) * ({p.format(_B)})" for p in _P)
_X, _Y, _Z = (f"(sin((1 - t) * a) / sin(a) * {p.format(_A)} + sin(t * a) / sin(a) * {p.format(_B)})" for p in _P)


@query(with_("field", f"""&g AS (SELECT k, k / {_N}.0::DOUBLE AS t, acos({_DOT}) AS a FROM range({_N + 1}) r(k)), p AS (SELECT k, degrees(atan2({_Y}, {_X})) AS lon, degrees(asin({_Z})) AS lat FROM g),
  q AS (SELECT k, (lon + 180) / 12 AS x, (lat + 80) / 8 AS y FROM p), c AS (SELECT k, CAST(floor(y) AS INT) + b AS j, CAST(floor(x) AS INT) + a AS i, abs(1 - a - (x - floor(x))) * abs(1 - b - (y - floor(y))) AS w FROM q, range(2) r(a), range(2) s(b))
  SELECT k, CASE WHEN count(*) = count(v) THEN round(sum(w * v), 6) END AS value FROM c LEFT JOIN field USING (j, i) WHERE w > 0 GROUP BY 1"""))
def transect(spark, d):
    found = sections.transect(field(spark, d), "v", (*_A, *_B), _N, -180.0, 12.0, -80.0, 8.0)
    return found.select("k", r6("value").alias("value"))


@query(with_("field masked", "SELECT j, i, round(CASE WHEN m.v IS NOT NULL THEN 0.6 * m.v + 0.4 * (f.v + 1) ELSE f.v + 1 END, 6) AS v FROM field f JOIN masked m USING (j, i)"))
def merged_fields(spark, d):
    low = field(spark, d).select("j", "i", (F.col("v") + 1).alias("v"), F.lit(1.0).alias("cover"))
    top = masked(spark, d).withColumn("cover", F.lit(0.6))
    return sections.merge_fields([low, top], "v").select("j", "i", r6("v").alias("v"))


@query(with_("field masked", "SELECT min(j) AS jmin, max(j) AS jmax, min(i) AS imin, max(i) AS imax FROM masked WHERE v > 25"))
def mask_box(spark, d):
    return select.mask_box(masked(spark, d), [], F.col("v") > 25)


@query(with_("field masked", "SELECT i, min(j) AS first, max(j) AS last FROM (SELECT i, j, j - row_number() OVER (PARTITION BY i ORDER BY j) AS r FROM masked WHERE v IS NOT NULL) GROUP BY i, r"))
def runs_of_cells(spark, d):
    return select.index_runs(masked(spark, d).filter("v is not null"), ["i"], "j")


@query(with_("field masked", """&l AS (SELECT j, i, v IS NULL AS l FROM masked) SELECT j, i, l OR coalesce(lead(l) OVER (PARTITION BY j ORDER BY i), l) AS land_u, l OR coalesce(lead(l) OVER (PARTITION BY i ORDER BY j), l) AS land_v FROM l"""))
def land_at_uv_points(spark, d):
    return select.uv_masks(masked(spark, d).withColumn("l", F.col("v").isNull()), [], "l")


@query(with_("stations", "SELECT min(k)::INT AS first, (max(k) + 1)::INT AS last FROM (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS k FROM (SELECT DISTINCT lat FROM stations)) WHERE lat >= -20 AND lat < 40"))
def index_range(spark, d):
    return select.index_range(stations(spark, d).select("lat").distinct(), "lat", -20.0, 40.0, "co")


@query(with_("buoys", "SELECT buoy FROM buoys WHERE lon >= -30 AND lon < 60.5 AND lat > 10"))
def select_box(spark, d):
    return buoys(spark, d).filter(select.selector(lon=(-30.0, 60.5, "co"), lat=(10.0, None, "oc"))).select("buoy")


@query(with_("field", f"""&g AS (SELECT j, i, i * 12.0::DOUBLE - 180 AS lon, j * 8.0::DOUBLE - 80 AS lat FROM field),
  s AS (SELECT 2 * {units.EARTH_RADIUS!r}::DOUBLE * asin(least(1, cos(radians(lat)) * abs(sin(radians(lead(lon) OVER (PARTITION BY j ORDER BY i) - lon) / 2)))) AS dx, {units.EARTH_RADIUS!r}::DOUBLE * radians(lead(lat) OVER (PARTITION BY i ORDER BY j) - lat) AS dy FROM g)
  SELECT round(median(dx), 3) AS dx, round(median(dy), 3) AS dy FROM s"""))
def grid_resolution(spark, d):
    g = field(spark, d).select("j", "i", (F.col("i") * 12.0 - 180).alias("lon"), (F.col("j") * 8.0 - 80).alias("lat"))
    return sections.resolution(g).select(F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy"))


@query(with_("field", """&g AS (SELECT j, i, CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END / 12 AS gx,
  CASE WHEN lag(v) OVER u IS NULL THEN lead(v) OVER u - v WHEN lead(v) OVER u IS NULL THEN v - lag(v) OVER u ELSE (lead(v) OVER u - lag(v) OVER u) / 2 END / 8 AS gy FROM field WINDOW w AS (PARTITION BY j ORDER BY i), u AS (PARTITION BY i ORDER BY j))
  SELECT j, i, round(sqrt(gx * gx + gy * gy), 6) AS gradient FROM g"""))
def gradient(spark, d):
    return grid.gradient(field(spark, d), [], "v", 12.0, 8.0).select("j", "i", r6("gradient").alias("gradient"))


@query(with_("field masked", """SELECT j, min(v) AS low, arg_min(i, (v, i)) AS low_at, max(v) AS high, arg_max(i, (v, -i)) AS high_at FROM (SELECT j, i, round(v, 6) AS v FROM masked) WHERE v IS NOT NULL GROUP BY j"""))
def section_extrema(spark, d):
    return grid.section_extrema(masked(spark, d).withColumn("v", r6("v")), ["j"], "v", "i")


@query(with_("field masked", f"""&w AS (SELECT j, i, i * 12.0::DOUBLE - 180 AS lon, j * 8.0::DOUBLE - 80 AS lat, v IS NULL AS land FROM masked)
  SELECT a.j, a.i, round(min(2 * {units.EARTH_RADIUS!r}::DOUBLE * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))), 3) AS distance
  FROM w a, w b WHERE NOT a.land AND b.land GROUP BY 1, 2"""))
def distance_to_coast(spark, d):
    cells = masked(spark, d).select((F.col("j") * 100 + F.col("i")).alias("cell"), (F.col("i") * 12.0 - 180).alias("lon"), (F.col("j") * 8.0 - 80).alias("lat"), F.col("v").isNull().alias("land"))
    land = cells.filter("land")
    found = nearest(cells.filter("not land"), "cell", land, "cell", 24.0, out="coast")
    return found.select(F.floor(F.col("cell") / 100).cast("int").alias("j"), (F.col("cell") % 100).alias("i"), F.round("distance", 3).alias("distance"))


@query(with_("field masked", """&near(dj, di) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), m AS (SELECT a.j, a.i, avg(b.v) AS n FROM masked a, near JOIN masked b ON b.j = a.j + dj AND b.i = a.i + di GROUP BY 1, 2)
  SELECT j, i, round(coalesce(v, n), 6) AS v FROM masked JOIN m USING (j, i)"""))
def filled_coast(spark, d):
    return grid.erode(masked(spark, d), [], "v", F.lit(True), rounds=1).select("j", "i", r6("v").alias("v"))
