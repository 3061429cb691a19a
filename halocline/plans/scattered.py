"""Queries: thinning by radius, nearest points, local planes, cells of any shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.functions.units import compass
from halocline.operators import coast, neighbours, overlaps, thinning
from halocline.plans.gridding import _MOVED, _moved
from halocline.plans.inputs import buoys, field, masked, r6, table, with_
from halocline.plans.registry import register

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


# one point after another, in the order of their keys

_GREEDY = """o AS (SELECT row_number() OVER (ORDER BY buoy) AS n, buoy, lon AS x, lat AS y, v FROM buoys),
  g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[]) AS kept
    UNION ALL SELECT g.n + 1, CASE WHEN len(list_filter(kept, lambda p: sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) < 24.7::DOUBLE)) > 0 THEN kept ELSE list_append(kept, {'k': CAST(buoy AS BIGINT), 'x': o.x, 'y': o.y}) END FROM g JOIN o ON o.n = g.n + 1),
  kept AS (SELECT p.k AS buoy, p.x AS x, p.y AS y FROM (SELECT unnest(kept) AS p FROM g WHERE n = (SELECT max(n) FROM o)))"""


@query(with_("buoys", f"&{_GREEDY} SELECT buoy, x AS lon, y AS lat FROM kept").replace("WITH ", "WITH RECURSIVE ", 1))
def thinned_by_radius(spark, d):
    return thinning.thin_by_radius(buoys(spark, d), "buoy", 24.7, "lon", "lat").select(F.col("buoy").cast("long").alias("buoy"), "lon", "lat")


@query(with_("buoys", f"&{_GREEDY} SELECT k.buoy, round(avg(o.v), 6) AS v FROM kept k, o WHERE sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y)) < 24.7::DOUBLE * 0.7::DOUBLE GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1))
def thinned_means(spark, d):
    found = thinning.thin_by_radius(buoys(spark, d), "buoy", 24.7, "lon", "lat", "v", 0.7)
    return found.select(F.col("buoy").cast("long").alias("buoy"), r6("v").alias("v"))


# neighbours

_NEAR = f"""{_MOVED}, q AS (SELECT buoy, lon * 0.97::DOUBLE + 0.123::DOUBLE AS x, lat * 0.97::DOUBLE + 0.321::DOUBLE AS y FROM buoys),
  n AS (SELECT * FROM (SELECT buoy, q.x, q.y, k, s.x AS px, s.y AS py, s.z AS pz, sqrt(pow(s.x - q.x, 2) + pow(s.y - q.y, 2)) AS d, row_number() OVER (PARTITION BY buoy ORDER BY sqrt(pow(s.x - q.x, 2) + pow(s.y - q.y, 2)), k) AS rank FROM q, s) WHERE rank <= 12)"""


def _places(spark, d):
    return buoys(spark, d).select("buoy", (F.col("lon") * 0.97 + 0.123).alias("x"), (F.col("lat") * 0.97 + 0.321).alias("y"))


@query(with_("stations buoys", f"&{_NEAR} SELECT buoy, CAST(rank AS INT) AS rank, k AS station, round(d, 6) AS distance FROM n"))
def twelve_nearest(spark, d):
    found = neighbours.k_nearest(_places(spark, d), "buoy", _moved(spark, d), "k", 12)
    return found.select("buoy", "rank", F.col("k").alias("station"), r6("distance").alias("distance"))


def _planes(both: bool) -> str:
    turned = "CASE WHEN {f}.y - y - c * ({f}.x - x) > 0 THEN {s} <= 0 ELSE {s} >= 0 END" if both else "{f}.y - y - c * ({f}.x - x) > 0 AND {s} <= 0"
    beyond = turned.format(f="f", s="p.y - y - c * (p.x - x)")
    return f"""{_NEAR}, l AS (SELECT buoy, any_value(x) AS x, any_value(y) AS y, list({{'x': px, 'y': py, 'z': pz}} ORDER BY rank) AS v FROM n GROUP BY buoy),
  o AS (SELECT buoy, x, y, 1 AS o, v[1] AS f, v[2:] AS r FROM l UNION ALL SELECT buoy, x, y, 2, v[2], list_concat([v[1]], v[3:]) FROM l UNION ALL SELECT buoy, x, y, 3, v[3], list_concat([v[1], v[2]], v[4:]) FROM l),
  a AS (SELECT *, CASE WHEN m = 0 THEN 1e-20 ELSE m END AS a FROM (SELECT *, (f.y - y) / CASE WHEN f.x = x THEN 1e-9 ELSE f.x - x END AS m FROM o)),
  c AS (SELECT *, -1 / a AS c FROM a),
  b AS (SELECT *, list_filter(r, lambda p: {beyond}) AS b FROM c),
  t AS (SELECT *, list_filter(b, lambda p: p.y - y - a * (p.x - x) > 0)[1] AS g, list_filter(b, lambda p: p.y - y - a * (p.x - x) <= 0)[1] AS h FROM b),
  e AS (SELECT *, (g.x - f.x) * (h.y - f.y) - (g.y - f.y) * (h.x - f.x) AS det FROM t WHERE g IS NOT NULL AND h IS NOT NULL),
  w AS (SELECT buoy, o, f.z + ((g.z - f.z) * (h.y - f.y) - (g.y - f.y) * (h.z - f.z)) / det * (x - f.x) + ((g.x - f.x) * (h.z - f.z) - (g.z - f.z) * (h.x - f.x)) / det * (y - f.y) AS value FROM e)
  SELECT buoy, round(coalesce(arg_min(w.value, w.o), any_value(l.v[1].z)), 5) AS value FROM l LEFT JOIN w USING (buoy) GROUP BY buoy"""


@query(with_("stations buoys", f"&{_planes(False)}"))
def local_planes(spark, d):
    found = neighbours.local_planes(_moved(spark, d), "k", _places(spark, d), "buoy")
    return found.select("buoy", F.round("value", 5).alias("value"))


@query(with_("stations buoys", f"&{_planes(True)}"))
def local_planes_on_both_sides(spark, d):
    found = neighbours.local_planes(_moved(spark, d), "k", _places(spark, d), "buoy", both=True)
    return found.select("buoy", F.round("value", 5).alias("value"))


# cells of any shape: a bent grid of the field's cells, and a coarser one that is turned the other way

_BENT = ("{i} + 0.3::DOUBLE * {j} + 0.01::DOUBLE * {i} * {i}", "{j} - 0.2::DOUBLE * {i} + 0.005::DOUBLE * {i} * {j}")
_TURNED = ("4.3::DOUBLE * {i} - 0.7::DOUBLE * {j} - 1.2::DOUBLE", "3.7::DOUBLE * {j} + 0.4::DOUBLE * {i} - 5.3::DOUBLE")


def _quad(shape) -> str:
    """The corners of a cell, counter-clockwise, as a list in SQL."""
    corner = lambda b, a: "{" + ", ".join(f"'{n}': {e.format(j=f'(j + {b})', i=f'(i + {a})')}" for n, e in zip("xy", shape, strict=True)) + "}"
    return f"[{corner('-0.5::DOUBLE', '-0.5::DOUBLE')}, {corner('-0.5::DOUBLE', '0.5::DOUBLE')}, {corner('0.5::DOUBLE', '0.5::DOUBLE')}, {corner('0.5::DOUBLE', '-0.5::DOUBLE')}]"


def _clip(k: int) -> str:
    """One side of the target's cell cuts what the sides before have left."""
    left = lambda v: f"(b.x - a.x) * ({v}.y - a.y) - (b.y - a.y) * ({v}.x - a.x)"
    p, q = "p[n]", "p[n % len(p) + 1]"
    share = f"(({left(p)}) / (({left(p)}) - ({left(q)})))"
    cross = f"{{'x': {p}.x + {share} * ({q}.x - {p}.x), 'y': {p}.y + {share} * ({q}.y - {p}.y)}}"
    return f"""k{k} AS (SELECT sj, si, tj, ti, t, flatten(list_transform(range(1, len(p) + 1), lambda n: CASE WHEN {left(p)} >= 0 THEN CASE WHEN {left(q)} >= 0 THEN [{p}] ELSE [{p}, {cross}] END WHEN {left(q)} >= 0 THEN [{cross}] ELSE [] END)) AS p
    FROM (SELECT *, t[{k}] AS a, t[{k % 4 + 1}] AS b FROM k{k - 1}))"""


def _shoelace(v: str) -> str:
    return f"abs(list_sum(list_transform(range(1, len({v}) + 1), lambda n: {v}[n].x * {v}[n % len({v}) + 1].y - {v}[n % len({v}) + 1].x * {v}[n].y))) / 2"


_AREAS = f"""s AS (SELECT j AS sj, i AS si, {_quad(_BENT)} AS s FROM field), t AS (SELECT j AS tj, i AS ti, {_quad(_TURNED)} AS t FROM (SELECT DISTINCT j // 3 AS j, i // 4 AS i FROM field)),
  k0 AS (SELECT sj, si, tj, ti, t, s AS p FROM s, t), {", ".join(_clip(k) for k in range(1, 5))},
  areas AS (SELECT sj, si, tj, ti, area FROM (SELECT sj, si, tj, ti, {_shoelace("p")} AS area FROM k4 WHERE len(p) > 2) WHERE area > 0)"""


def _corners(shape):
    at = lambda e, b, a: F.expr(e.replace("::DOUBLE", "D").format(j=f"(j + {b}D)", i=f"(i + {a}D)"))
    return F.array(*[F.struct(*[at(e, b, a).alias(n) for n, e in zip("xy", shape, strict=True)]) for b, a in ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5))])


def _cells(spark, d):
    f = field(spark, d).select("j", "i")
    coarse = f.select(F.floor(F.col("j") / 3).cast("int").alias("j"), F.floor(F.col("i") / 4).cast("int").alias("i")).distinct()
    return f.withColumn("corners", _corners(_BENT)), coarse.withColumn("corners", _corners(_TURNED))


@query(with_("field", f"&{_AREAS} SELECT sj, si, tj, ti, round(area, 6) AS area FROM areas WHERE area > 1e-6"))
def shared_areas(spark, d):
    return overlaps.shared_areas(*_cells(spark, d), 5.0).filter("area > 1e-6").select("sj", "si", "tj", "ti", r6("area").alias("area"))


@query(with_("field masked", f"&{_AREAS} SELECT tj AS j, ti AS i, round(sum(v * area) / sum(area), 6) AS v FROM masked m JOIN areas ON sj = m.j AND si = m.i WHERE v IS NOT NULL AND area > 1e-6 GROUP BY 1, 2"))
def curved_average(spark, d):
    weights = overlaps.shared_areas(*_cells(spark, d), 5.0).filter("area > 1e-6")
    return overlaps.regrid(masked(spark, d), [], "v", weights).select("j", "i", r6("v").alias("v"))


@query(with_("field masked", f"&{_AREAS} SELECT m.tj AS j, m.ti AS i, round(m.total / ({_shoelace('t')}), 6) AS v FROM (SELECT tj, ti, sum(v * area) AS total FROM masked m JOIN areas ON sj = m.j AND si = m.i WHERE v IS NOT NULL AND area > 1e-6 GROUP BY 1, 2) m JOIN t USING (tj, ti)"))
def curved_conservative(spark, d):
    source, target = _cells(spark, d)
    weights = overlaps.shared_areas(source, target, 5.0).filter("area > 1e-6")
    return overlaps.regrid(masked(spark, d), [], "v", weights, target, "conserve").select("j", "i", r6("v").alias("v"))


# a coast a nation, of the places of its customers, and stations along it

_COAST = """corners AS (SELECT nation, n, n + 0.3::DOUBLE * sin(c) AS x, nation * 5 + cos(c * 0.7::DOUBLE) AS y FROM (SELECT c_nationkey AS nation, c_custkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)),
  arc AS (SELECT *, sum(d) OVER (PARTITION BY nation ORDER BY n) AS s FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM corners WINDOW w AS (PARTITION BY nation ORDER BY n))),
  seg AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM arc WINDOW w AS (PARTITION BY nation ORDER BY n)),
  st AS (SELECT s_suppkey AS station, s_acctbal AS z, (s_suppkey * 7) % 61 + 0.4::DOUBLE AS px, s_nationkey * 5 + 0.5::DOUBLE AS py FROM supplier),
  f AS (SELECT *, greatest(0, least(1, ((px - x) * (bx - x) + (py - y) * (by_ - y)) / (pow(bx - x, 2) + pow(by_ - y, 2)))) AS f FROM st, seg WHERE bx IS NOT NULL),
  g AS (SELECT station, z, nation, s + f * sqrt(pow(bx - x, 2) + pow(by_ - y, 2)) AS s, sqrt(pow(px - x - f * (bx - x), 2) + pow(py - y - f * (by_ - y), 2)) AS d FROM f),
  placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY d, nation, s) AS k FROM g WHERE d <= 3) WHERE k = 1)"""


def _coast(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("line"), F.col("c_custkey").alias("c")).withColumn("n", F.row_number().over(W.partitionBy("line").orderBy("c")))
    lines = c.select("line", "n", (F.col("n") + 0.3 * F.sin("c")).alias("x"), (F.col("line") * 5 + F.cos(F.col("c") * 0.7)).alias("y"))
    s = table(spark, d, "supplier")
    at = s.select(F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("level"), ((F.col("s_suppkey") * 7) % 61 + 0.4).alias("x"), (F.col("s_nationkey") * 5 + 0.5).alias("y"))
    coast.register_shoreline("customers", lambda spark, **_: lines)
    return coast.shoreline(spark, "customers"), at


@query(f"WITH {_COAST} SELECT station, nation, round(s, 6) AS s, round(d, 6) AS distance FROM placed")
def stations_along_coasts(spark, d):
    lines, at = _coast(spark, d)
    found = coast.along(at, "station", coast.measured(lines), 3.0)
    return found.select("station", F.col("line").alias("nation"), r6("s").alias("s"), r6("distance").alias("distance"))


def _levels(smooth: bool, beyond: str) -> str:
    w = "w * w * (3 - 2 * w)" if smooth else "w"
    return f"""WITH {_COAST}, e AS (SELECT a.nation, n, a.s, max(p.s) FILTER (p.s <= a.s) AS s0, arg_max(p.z, p.s) FILTER (p.s <= a.s) AS z0, min(p.s) FILTER (p.s >= a.s) AS s1, arg_min(p.z, p.s) FILTER (p.s >= a.s) AS z1
      FROM arc a LEFT JOIN (SELECT nation, s, avg(z) AS z FROM placed GROUP BY 1, 2) p ON p.nation = a.nation GROUP BY 1, 2, 3),
    h AS (SELECT *, CASE WHEN s1 > s0 THEN (s - s0) / (s1 - s0) ELSE 0 END AS w FROM e)
    SELECT nation, n, round(2 * CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN z0 + {w} * (z1 - z0) ELSE {beyond} END, 5) AS z FROM h"""


@query(_levels(False, "coalesce(z0, z1)"))
def coastal_soundings(spark, d):
    """Twice the level between the stations of each coast, beyond the last ones theirs."""
    lines, at = _coast(spark, d)
    return coast.coastal_depths(at, "station", "level", lines, 3.0).select(F.col("line").alias("nation"), "n", F.round("z", 5).alias("z"))


@query(_levels(True, "NULL"))
def coastal_soundings_smooth(spark, d):
    lines, at = _coast(spark, d)
    return coast.coastal_depths(at, "station", "level", lines, 3.0, extrapolate=False, smooth=True).select(F.col("line").alias("nation"), "n", F.round("z", 5).alias("z"))


# sections along the ways of a nation's suppliers, through a grid that is turned and stretched

_WAY = """v AS (SELECT line, n, u, w, u + 0.3::DOUBLE * w AS x, w - 0.2::DOUBLE * u AS y FROM (SELECT s_nationkey AS line, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, (s_suppkey * 7 % 290) / 10.0::DOUBLE + 0.013::DOUBLE AS u, (s_suppkey * 11 % 190) / 10.0::DOUBLE + 0.017::DOUBLE AS w FROM supplier)),
  sg AS (SELECT *, lead(u) OVER p AS bu, lead(w) OVER p AS bw, sqrt(pow(lead(x) OVER p - x, 2) + pow(lead(y) OVER p - y, 2)) AS len FROM v WINDOW p AS (PARTITION BY line ORDER BY n)),
  sl AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY n) - len AS s FROM sg WHERE bu IS NOT NULL),
  t AS (SELECT line, n, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS t FROM sl UNION SELECT line, n, (k - u) / (bu - u) FROM sl, range(31) r(k) WHERE bu <> u AND (k - u) / (bu - u) BETWEEN 0 AND 1 UNION SELECT line, n, (k - w) / (bw - w) FROM sl, range(21) r(k) WHERE bw <> w AND (k - w) / (bw - w) BETWEEN 0 AND 1),
  pc AS (SELECT line, n, t, lead(t) OVER (PARTITION BY line, n ORDER BY t) AS t1 FROM t),
  m AS (SELECT line, s + (t + t1) / 2 * len AS s, (t1 - t) * len AS length, u + (t + t1) / 2 * (bu - u) AS mu, w + (t + t1) / 2 * (bw - w) AS mw FROM pc JOIN sl USING (line, n) WHERE t1 - t > 1e-12),
  q AS (SELECT line, s, length, CAST(floor(mw) AS INT) + b AS j, CAST(floor(mu) AS INT) + a AS i, abs(1 - a - (mu - floor(mu))) * abs(1 - b - (mw - floor(mw))) AS wt FROM m, range(2) r(a), range(2) z(b))"""


def _ways(spark, d):
    from pyspark.sql import Window as W

    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("line"), F.col("s_suppkey").alias("k"))
    s = s.select("line", F.row_number().over(W.partitionBy("line").orderBy("k")).alias("n"), ((F.col("k") * 7 % 290) / 10.0 + 0.013).alias("u"), ((F.col("k") * 11 % 190) / 10.0 + 0.017).alias("w"))
    lines = coast.measured(s.select("line", "n", (F.col("u") + 0.3 * F.col("w")).alias("x"), (F.col("w") - 0.2 * F.col("u")).alias("y")))
    grid = field(spark, d).select("j", "i", (F.col("i") + 0.3 * F.col("j")).alias("x"), (F.col("j") - 0.2 * F.col("i")).alias("y"))
    return coast.pieces(lines, grid, 3.0)


@query(with_("field", f"&{_WAY} SELECT line, round(s, 6) AS s, round(any_value(length), 6) AS length FROM q JOIN field USING (j, i) GROUP BY line, q.s HAVING count(*) = 4"))
def pieces_of_ways(spark, d):
    return _ways(spark, d).select("line", r6("s").alias("s"), r6("length").alias("length"))


@query(with_("field masked", f"&{_WAY} SELECT line, level, round(s, 6) AS s, CASE WHEN count(v) = 4 THEN round(sum(v * wt) * (1 + level), 6) END AS v, round(-10.0::DOUBLE * level * sum((20 + j) * wt), 6) AS depth FROM q JOIN masked USING (j, i), range(3) l(level) GROUP BY line, level, q.s HAVING count(*) = 4"))
def section_of_bent_grid(spark, d):
    """Three levels along each way, with the depths of levels that follow the ground."""
    levels = masked(spark, d).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    levels = levels.withColumns({"v": F.col("v") * (1 + F.col("level")), "depth": -10.0 * F.col("level") * (20 + F.col("j"))})
    found = coast.along_section(_ways(spark, d), levels, ["v", "depth"], ["level"])
    return found.select("line", "level", r6("s").alias("s"), r6("v").alias("v"), (r6("depth") + 0.0).alias("depth"))


# small ones

@query("SELECT event_id, ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][CAST(floor((event_id * 7.3::DOUBLE % 360 + 11.25) / 22.5) % 16 + 1 AS INT)] AS clockwise, ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][CAST((floor((90 - event_id * 7.3::DOUBLE % 360 + 11.25) / 22.5) + 16) % 16 + 1 AS INT)] AS mathematical FROM events")
def compass_points(spark, d):
    angle = F.col("event_id") * 7.3 % 360
    return table(spark, d, "events").select("event_id", compass(angle).alias("clockwise"), compass(angle, False).alias("mathematical"))


@query("SELECT event_type AS kind, count(*) AS size, count(*) FILTER (event_id % 4 <> 0) AS n, round(avg(value) FILTER (event_id % 4 <> 0), 6) AS mean FROM events GROUP BY 1")
def masked_nans(spark, d):
    """Not-a-numbers count as missing: here every fourth value is one."""
    from halocline.operators import stats

    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    found = stats.accumulate(e.withColumn("v", stats.mask_nan(F.col("v"))), ["kind"], "v")
    return found.select("kind", "size", F.col("count").alias("n"), r6("mean_x").alias("mean"))
