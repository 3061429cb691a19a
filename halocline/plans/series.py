"""Queries: filters, differences, gaps, interpolation along an axis, times, tide."""

from __future__ import annotations

from pyspark.sql import functions as F

from halocline.functions import times
from halocline.operators import interp, profiles as prof, stats, tide, windows
from halocline.plans.inputs import profiles, r6, series, table, with_
from halocline.plans.registry import register
from halocline.sources.files import best_estimate

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)

_W = "WINDOW w AS (PARTITION BY kind ORDER BY t)"


def _filter_sql(weights: list[float]) -> str:
    half = len(weights) // 2
    shifts = [(f"lag(v, {half - i}) OVER w" if i < half else f"lead(v, {i - half}) OVER w" if i > half else "v", k) for i, k in enumerate(weights) if k]
    top = " + ".join(f"coalesce(({s}) * {k!r}::DOUBLE, 0)" for s, k in shifts)
    bottom = " + ".join(f"CASE WHEN ({s}) IS NOT NULL THEN {k!r}::DOUBLE ELSE 0 END" for s, k in shifts)
    return with_("series", f"SELECT kind, t, round(({top}) / ({bottom}), 4) AS filtered FROM series {_W}")


def _filtered(spark, d, weights):
    return windows.filter1d(series(spark, d), ["kind"], "t", "v", weights).select("kind", "t", F.round("filtered", 4).alias("filtered"))


# The weights as they should be, for the SQL alone.
for _name, _weights, _literal in (
    ("filter_shapiro", windows.shapiro(), [1.0, 2.0, 1.0]),
    ("filter_hamming", windows.hamming(5), [0.08, 0.54, 1.0, 0.54, 0.08]),
    ("filter_hanning", windows.hanning(7), [0.0, 0.25, 0.75, 1.0, 0.75, 0.25, 0.0]),
    ("filter_bartlett", windows.bartlett(7), [0.0, 0.333333333333333, 0.666666666666667, 1.0, 0.666666666666667, 0.333333333333333, 0.0]),
    ("filter_blackman", windows.blackman(9), [0.0, 0.066446609406726, 0.34, 0.773553390593274, 1.0, 0.773553390593274, 0.34, 0.066446609406726, 0.0]),
    ("filter_kaiser", windows.kaiser(7, 5.0), [0.036710892271287, 0.328201957372321, 0.775322104445407, 1.0, 0.775322104445407, 0.328201957372321, 0.036710892271287]),
    ("filter_gaussian", windows.gaussian(9), [0.820754808298268, 0.89483931681437, 0.951816784423089, 0.987730216235611, 1.0, 0.987730216235611, 0.951816784423089, 0.89483931681437, 0.820754808298268]),
):
    QUERIES[_name] = lambda spark, d, weights=_weights: _filtered(spark, d, weights)
    ORACLE[_name] = _filter_sql(_literal)


@query("""SELECT event_id, round((0.08::DOUBLE * coalesce(lag(value, 2) OVER w, 0) + 0.54::DOUBLE * coalesce(lag(value) OVER w, 0) + value + 0.54::DOUBLE * coalesce(lead(value) OVER w, 0) + 0.08::DOUBLE * coalesce(lead(value, 2) OVER w, 0))
  / (1 + CASE WHEN lag(value, 2) OVER w IS NULL THEN 0 ELSE 0.08 END + CASE WHEN lag(value) OVER w IS NULL THEN 0 ELSE 0.54 END + CASE WHEN lead(value) OVER w IS NULL THEN 0 ELSE 0.54 END + CASE WHEN lead(value, 2) OVER w IS NULL THEN 0 ELSE 0.08 END), 4) AS filtered
  FROM (SELECT event_id, value / 7.0137::DOUBLE AS value FROM events) WINDOW w AS (ORDER BY event_id)""")
def filter_of_one_long_series(spark, d):
    """All events as one series, filtered in chunks that overlap."""
    found = windows.filter_long(table(spark, d, "events").select("event_id", (F.col("value") / 7.0137).alias("value")), [], "event_id", "value", windows.hamming(5), chunk=500)
    return found.select("event_id", F.round("filtered", 4).alias("filtered"))


@query(with_("series", f"""&p AS (SELECT *, least(row_number() OVER w - 1, count(*) OVER (PARTITION BY kind) - row_number() OVER w, 2) AS reach FROM series {_W}),
  m AS (SELECT *, {", ".join(f"lag(v, {k}) OVER w AS b{k}, lead(v, {k}) OVER w AS a{k}" for k in (1, 2))} FROM p {_W})
  SELECT kind, t, round((v + CASE WHEN reach >= 1 THEN a1 + b1 ELSE 0 END + CASE WHEN reach >= 2 THEN a2 + b2 ELSE 0 END) / (1 + 2 * reach), 6) AS average FROM m"""))
def running_average(spark, d):
    return windows.running_average(series(spark, d), ["kind"], "t", "v", 5).select("kind", "t", r6("average").alias("average"))


@query(with_("series", f"""SELECT kind, t, round(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w
  ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END, 6) AS derivative FROM series {_W}"""))
def derivative_per_step(spark, d):
    return windows.derivative(series(spark, d), ["kind"], "t", "v").select("kind", "t", r6("derivative").alias("derivative"))


@query(with_("profiles", """SELECT profile, level, round(CASE WHEN lag(temp) OVER w IS NULL THEN (lead(temp) OVER w - temp) / (lead(depth) OVER w - depth)
  WHEN lead(temp) OVER w IS NULL THEN (temp - lag(temp) OVER w) / (depth - lag(depth) OVER w) ELSE (lead(temp) OVER w - lag(temp) OVER w) / (lead(depth) OVER w - lag(depth) OVER w) END, 6) + 0.0::DOUBLE AS derivative
  FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY level)"""))
def derivative_in_depth(spark, d):
    return windows.derivative(profiles(spark, d), ["profile"], "level", "temp", "depth").select("profile", "level", (r6("derivative") + 0.0).alias("derivative"))


@query(with_("profiles", """SELECT profile, level, round(CASE WHEN b IS NULL THEN depth - (a - depth) / 2 ELSE (b + depth) / 2 END, 6) AS lo, round(CASE WHEN a IS NULL THEN depth + (depth - b) / 2 ELSE (depth + a) / 2 END, 6) AS hi
  FROM (SELECT *, lag(depth) OVER w AS b, lead(depth) OVER w AS a FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY level))"""))
def cell_bounds(spark, d):
    return windows.bounds(profiles(spark, d), ["profile"], "level", "depth").select("profile", "level", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(with_("profiles", """SELECT profile, level, round(abs(CASE WHEN b IS NULL THEN a - depth WHEN a IS NULL THEN depth - b ELSE (a - b) / 2 END), 6) AS weight
  FROM (SELECT *, lag(depth) OVER w AS b, lead(depth) OVER w AS a FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY level))"""))
def mesh_weights(spark, d):
    return windows.mesh_weights(profiles(spark, d), ["profile"], "level", "depth").select("profile", "level", r6("weight").alias("weight"))


@query(with_("profiles", """SELECT profile, level, round(coalesce(abs(depth - lag(depth) OVER w), abs(lead(depth) OVER w - depth)), 6) AS dz FROM profiles WINDOW w AS (PARTITION BY profile ORDER BY level)"""))
def layer_thickness(spark, d):
    return windows.layer_thickness(profiles(spark, d), ["profile"], "level", "depth").select("profile", "level", r6("dz").alias("dz"))


@query(with_("profiles", "SELECT profile, level, round(-sum(temp) OVER (PARTITION BY profile ORDER BY level), 6) AS depth FROM profiles"))
def depth_of_layers(spark, d):
    found = windows.depth_of_layers(profiles(spark, d).withColumnRenamed("depth", "old"), ["profile"], "level", "temp")
    return found.select("profile", "level", r6("depth").alias("depth"))


_LON = "((buoy * 47) % 360 - 180)"


@query(f"""WITH p AS (SELECT c_custkey AS buoy, CAST((c_custkey * 47) % 360 - 180 AS DOUBLE) AS lon, CAST(c_nationkey AS INT) AS ship FROM customer),
  s AS (SELECT *, lon - lag(lon) OVER (PARTITION BY ship ORDER BY buoy) AS step FROM p)
  SELECT ship, buoy, lon + sum(CASE WHEN step > 180 THEN -360 WHEN step < -180 THEN 360 ELSE 0 END) OVER (PARTITION BY ship ORDER BY buoy) AS lon_unwrapped FROM s""")
def unwrap_longitudes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("buoy"), ((F.col("c_custkey") * 47) % 360 - 180).cast("double").alias("lon"), F.col("c_nationkey").alias("ship"))
    return windows.unwrap(c, ["ship"], "buoy", "lon").select("ship", "buoy", "lon_unwrapped")


_AXIS = """axis AS (SELECT kind, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM series GROUP BY kind),
  dense AS (SELECT kind, t, v FROM axis LEFT JOIN series USING (kind, t))"""


@query(with_("series", f"&{_AXIS} SELECT kind, t, round(v, 6) AS v FROM dense"))
def regular_axis(spark, d):
    return windows.regular(series(spark, d), ["kind"], "t", "1 hour").select("kind", "t", r6("v").alias("v"))


def _filled(max_gap: int) -> str:
    short = f"AND na - nb - 1 <= {max_gap}" if max_gap else ""
    return with_("series", f"""&{_AXIS}, n AS (SELECT *, row_number() OVER w AS i FROM dense {_W}),
  b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS nb, last_value(v IGNORE NULLS) OVER w AS vb,
        first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER u AS na, first_value(v IGNORE NULLS) OVER u AS va FROM n
        WINDOW w AS (PARTITION BY kind ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY kind ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT kind, t, round(CASE WHEN v IS NOT NULL THEN v WHEN true {short} THEN vb + (va - vb) * (i - nb) / (na - nb) END, 6) AS filled FROM b""")


def _hours():
    return F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("t")) / 3600.0


def _fill(spark, d, max_gap):
    dense = windows.regular(series(spark, d), ["kind"], "t", "1 hour")
    return windows.fill_gaps(dense, ["kind"], "t", "v", _hours(), max_gap).select("kind", "t", r6("filled").alias("filled"))


@query(_filled(0))
def fill_gaps(spark, d):
    return _fill(spark, d, 0)


@query(_filled(1))
def fill_short_gaps(spark, d):
    return _fill(spark, d, 1)


@query(with_("series", """SELECT kind, t AS before, n AS after, CAST(round(date_diff('second', t, n) / 3600.0) - 1 AS BIGINT) AS missing
  FROM (SELECT kind, t, lead(t) OVER (PARTITION BY kind ORDER BY t) AS n FROM series) WHERE date_diff('second', t, n) > 3960"""))
def time_gaps(spark, d):
    return windows.gaps(series(spark, d), ["kind"], "t", 3600.0)


@query(with_("series", """SELECT kind, median(s) AS step FROM (SELECT kind, date_diff('second', t, lead(t) OVER (PARTITION BY kind ORDER BY t))::DOUBLE AS s FROM series) GROUP BY kind"""))
def time_step(spark, d):
    return windows.time_step(series(spark, d), ["kind"], "t")


@query(with_("profiles", """SELECT profile, greatest(abs(max(s) - median(s)), abs(min(s) - median(s))) <= 0.05 * abs(median(s)) AS regular
  FROM (SELECT profile, lead(depth) OVER (PARTITION BY profile ORDER BY level) - depth AS s FROM profiles) GROUP BY profile"""))
def regular_depths(spark, d):
    return windows.is_regular(profiles(spark, d), ["profile"], "level", "depth")


_CROSS = """SELECT kind, round(x + (nx - x) * v / (v - nv), 4) AS position, CAST(sign(nv - v) AS INT) AS sign FROM (SELECT kind, x, v, lead(x) OVER w AS nx, lead(v) OVER w AS nv FROM (
  SELECT kind, t, date_diff('second', TIMESTAMP '2024-01-01', t) / 3600.0::DOUBLE AS x, v - 14 AS v FROM series) WINDOW w AS (PARTITION BY kind ORDER BY t))
  WHERE (v < 0 AND nv >= 0) OR (v > 0 AND nv <= 0)"""


@query(with_("series", _CROSS))
def level_crossings(spark, d):
    found = windows.crossings(series(spark, d), ["kind"], "t", "v", _hours(), 14.0)
    return found.select("kind", F.round("position", 4).alias("position"), "sign")


@query(with_("series", """&a AS (SELECT kind, t, v - avg(v) OVER (PARTITION BY kind) AS v FROM series),
  s AS (SELECT *, CASE WHEN v >= 0 THEN 1 ELSE -1 END AS sign FROM a),
  n AS (SELECT *, CASE WHEN sign <> lag(sign) OVER (PARTITION BY kind ORDER BY t) THEN 1 ELSE 0 END AS new FROM s),
  r AS (SELECT *, sum(new) OVER (PARTITION BY kind ORDER BY t) AS run FROM n),
  k AS (SELECT *, row_number() OVER (PARTITION BY kind, run ORDER BY v * sign DESC, t DESC) AS k, min(t) OVER (PARTITION BY kind, run) AS lo, max(t) OVER (PARTITION BY kind, run) AS hi FROM r)
  SELECT kind, t, round(v, 6) AS value, sign FROM k WHERE k = 1 AND t > lo AND t < hi"""))
def high_and_low_water(spark, d):
    a = stats.anomaly(series(spark, d), ["kind"], "v")
    return tide.high_and_low_water(a, ["kind"], "t", "anomaly").select("kind", "t", r6("value").alias("value"), "sign")


def _tide_sql(weights: list[float]) -> str:
    half = len(weights) // 2
    frame = f"OVER (PARTITION BY kind ORDER BY t ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    kernel = "[" + ", ".join(f"{w!r}::DOUBLE" for w in weights) + "]"
    return with_("series", f"""&{_AXIS}, full_ AS (SELECT kind, t, coalesce(v, 50) AS v FROM dense), f AS (SELECT kind, t, v, list(v) {frame} AS l FROM full_)
  SELECT kind, t, CASE WHEN len(l) = {len(weights)} THEN round(list_inner_product(l, {kernel}), 6) END AS surge, CASE WHEN len(l) = {len(weights)} THEN round(v - list_inner_product(l, {kernel}), 6) END AS tide FROM f""")


def _tide(spark, d, weights):
    dense = tide.hourly_axis(series(spark, d), ["kind"], "t").withColumn("v", F.coalesce("v", F.lit(50.0)))
    return tide.tide(dense, ["kind"], "t", "v", weights).select("kind", "t", r6("surge").alias("surge"), r6("tide").alias("tide"))


# Half of the weights from the outermost in, for the SQL alone; the second are of 14400.
_DEMERLIAC = [1, 3, 8, 15, 21, 32, 45, 55, 72, 91, 105, 128, 153, 171, 200, 231, 253, 288, 325, 351, 392, 435, 465, 512, 558, 586, 624, 658, 678, 704, 726, 738, 752, 762, 766, 768]
_GODIN = [1, 3, 6, 10, 15, 21, 28, 36, 45, 55, 66, 78, 91, 105, 120, 136, 153, 171, 190, 210, 231, 253, 276, 300, 323, 344, 363, 380, 395, 408, 419, 428, 435, 440, 443, 444]


def _mirrored(half: list[int]) -> list[float]:
    whole = half + half[-2::-1]
    return [w / sum(whole) for w in whole]


@query(_tide_sql(_mirrored(_DEMERLIAC)))
def tide_demerliac(spark, d):
    return _tide(spark, d, tide.demerliac())


@query(_tide_sql(_mirrored(_GODIN)))
def tide_godin(spark, d):
    return _tide(spark, d, tide.godin())


# interpolation of each series to a ten-minute axis

_X = "date_diff('second', TIMESTAMP '2024-01-01', t)::DOUBLE"
_TARGET = f"src AS (SELECT kind, {_X} AS x, v FROM series), dst AS (SELECT kind, unnest(generate_series(min(x)::BIGINT - 1800, max(x)::BIGINT + 1800, 600))::DOUBLE AS x FROM src GROUP BY kind)"
_BRACKET = """l AS (SELECT d.kind, d.x, s.x AS lx, s.v AS lv FROM dst d ASOF LEFT JOIN src s ON d.kind = s.kind AND d.x >= s.x),
  b AS (SELECT l.*, s.x AS hx, s.v AS hv FROM l ASOF LEFT JOIN src s ON l.kind = s.kind AND l.x <= s.x)"""


def _axes(spark, d):
    s = series(spark, d)
    x = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("t")).cast("double")
    src = s.select("kind", x.alias("x"), "v")
    ends = src.groupBy("kind").agg(F.min("x").cast("long").alias("a"), F.max("x").cast("long").alias("b"))
    dst = ends.select("kind", F.explode(F.sequence(F.col("a") - 1800, F.col("b") + 1800, F.lit(600).cast("long"))).alias("x")).withColumn("x", F.col("x").cast("double"))
    return src, dst


def _interpolated(spark, d, **how):
    src, dst = _axes(spark, d)
    return interp.interp1d(src, dst, ["kind"], "x", "v", **how).select("kind", "x", r6("value").alias("value"))


@query(with_("series", f"&{_TARGET}, {_BRACKET} SELECT kind, x, round(CASE WHEN x = lx THEN lv WHEN x = hx THEN hv ELSE lv + (hv - lv) * (x - lx) / (hx - lx) END, 6) AS value FROM b"))
def interpolate_linear(spark, d):
    return _interpolated(spark, d, method="linear")


@query(with_("series", f"&{_TARGET}, {_BRACKET} SELECT kind, x, round(CASE WHEN x = lx THEN lv WHEN x = hx THEN hv WHEN lx IS NULL OR hx IS NULL THEN NULL WHEN x - lx < hx - x THEN lv ELSE hv END, 6) AS value FROM b"))
def interpolate_nearest(spark, d):
    return _interpolated(spark, d, method="nearest")


@query(with_("series", f"&{_TARGET}, {_BRACKET} SELECT kind, x, round(CASE WHEN x = lx THEN lv WHEN x = hx THEN hv WHEN lx IS NULL THEN hv WHEN hx IS NULL THEN lv ELSE lv + (hv - lv) * (x - lx) / (hx - lx) END, 6) AS value FROM b"))
def interpolate_extrapolated(spark, d):
    return _interpolated(spark, d, method="linear", extrapolate="both")


@query(with_("series", f"""&{_TARGET.replace("src AS (SELECT kind,", "base AS (SELECT kind,").replace("FROM src GROUP", "FROM base GROUP")},
  src AS (SELECT kind, x, v, lag(v) OVER w AS pv, lag(x) OVER w AS px, lead(v) OVER w AS nv, lead(x) OVER w AS nx FROM base WINDOW w AS (PARTITION BY kind ORDER BY x)),
  l AS (SELECT d.kind, d.x, s.x AS lx, s.v AS lv, s.pv, s.px FROM dst d ASOF LEFT JOIN src s ON d.kind = s.kind AND d.x >= s.x),
  b AS (SELECT l.*, s.x AS hx, s.v AS hv, s.nv, s.nx FROM l ASOF LEFT JOIN src s ON l.kind = s.kind AND l.x <= s.x),
  c AS (SELECT *, (x - lx) / (hx - lx) AS p, (hv - CASE WHEN px IS NULL THEN 2 * lv - hv ELSE pv END) / 2 AS m0, (CASE WHEN nx IS NULL THEN 2 * hv - lv ELSE nv END - lv) / 2 AS m1 FROM b)
  SELECT kind, x, round(CASE WHEN x = lx THEN lv WHEN x = hx THEN hv ELSE (2*p*p*p - 3*p*p + 1) * lv + (p*p*p - 2*p*p + p) * m0 + (3*p*p - 2*p*p*p) * hv + (p*p*p - p*p) * m1 END, 6) AS value FROM c"""))
def interpolate_hermite(spark, d):
    return _interpolated(spark, d, method="hermite")


_DST = "dst AS (SELECT profile, k, -15.0::DOUBLE * (k + 1) AS d_lo, -15.0::DOUBLE * k AS d_hi FROM (SELECT DISTINCT profile FROM profiles), range(5) r(k))"
_CELLS = "src AS (SELECT profile, depth - 5 AS lo, depth + 5 AS hi, temp FROM profiles)"


def _layers(spark, d):
    p = profiles(spark, d)
    dst = p.select("profile").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumns({"d_lo": -15.0 * (F.col("k") + 1), "d_hi": -15.0 * F.col("k")})
    return p.withColumns({"lo": F.col("depth") - 5, "hi": F.col("depth") + 5}), dst


def _remap_sql(value: str) -> str:
    return with_("profiles", f"&{_CELLS}, {_DST}, o AS (SELECT s.profile, k, temp, hi - lo AS width, least(hi, d_hi) - greatest(lo, d_lo) AS w FROM src s JOIN dst d ON s.profile = d.profile AND lo < d_hi AND hi > d_lo) SELECT profile, CAST(k AS INT) AS k, round({value}, 6) AS value FROM o GROUP BY 1, 2")


@query(_remap_sql("sum(temp * w) / sum(w)"))
def remap_average(spark, d):
    src, dst = _layers(spark, d)
    return interp.cell_average(src, dst, ["profile"], ["k"], "temp", 15.0).select("profile", "k", r6("value").alias("value"))


@query(_remap_sql("sum(temp * w / width)"))
def remap_conservative(spark, d):
    src, dst = _layers(spark, d)
    return interp.cell_average(src, dst, ["profile"], ["k"], "temp", 15.0, conserve=True).select("profile", "k", r6("value").alias("value"))


@query(with_("profiles", f"""&{_DST}, w AS (SELECT p.profile, k, temp, 1 / (((level % 3 + 1) * 0.1::DOUBLE) * ((level % 3 + 1) * 0.1::DOUBLE) + 0.05::DOUBLE * abs(depth - (d_lo + 7.5::DOUBLE))) AS w
  FROM profiles p JOIN dst d ON p.profile = d.profile AND depth >= d_lo AND depth < d_hi)
  SELECT profile, CAST(k AS INT) AS k, round(sum(w * temp) / sum(w), 6) AS value, round(1 / sqrt(sum(w)), 6) AS error FROM w GROUP BY 1, 2"""))
def remap_by_error(spark, d):
    p, dst = _layers(spark, d)
    p = p.drop("lo", "hi").withColumn("e", (F.col("level") % 3 + 1) * 0.1)
    found = interp.cell_error(p, dst.withColumn("x_out", F.col("d_lo") + 7.5), ["profile"], ["k"], "depth", "temp", "e", 0.05, 15.0)
    return found.select("profile", "k", r6("value").alias("value"), r6("error").alias("error"))


@query("""WITH clim AS (SELECT CAST(month(o_orderdate) AS INT) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1),
  t AS (SELECT o_orderkey AS id, date_trunc('hour', o_orderdate) AS t, make_timestamp(year(o_orderdate), month(o_orderdate), 15, 0, 0, 0) AS mid FROM orders),
  f AS (SELECT id, t, CASE WHEN t >= mid THEN mid ELSE mid - INTERVAL 1 MONTH END AS a FROM t),
  p AS (SELECT id, t, a, a + INTERVAL 1 MONTH AS b FROM f)
  SELECT id, round(x.v + (y.v - x.v) * date_diff('second', a, t) / date_diff('second', a, b)::DOUBLE, 6) AS value FROM p JOIN clim x ON x.m = month(a) JOIN clim y ON y.m = month(b)""")
def climatology_at_times(spark, d):
    o = table(spark, d, "orders")
    clim = o.groupBy(F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v"))
    at = o.select(F.col("o_orderkey").alias("id"), F.date_trunc("hour", "o_orderdate").cast("timestamp_ntz").alias("t"))
    return interp.climatology(clim, at, [], "m", "t", "v").select("id", r6("value").alias("value"))


@query("""WITH b AS (SELECT event_id, event_type AS kind, ts, value, CAST(event_id % 3 AS INT) AS batch FROM events WHERE date_diff('day', TIMESTAMP '2024-01-01', ts) >= (event_id % 3) * 7),
  f AS (SELECT kind, batch, min(ts) AS first FROM b GROUP BY 1, 2), u AS (SELECT kind, batch, lead(first) OVER (PARTITION BY kind ORDER BY batch) AS until FROM f)
  SELECT event_id, kind, b.batch, round(value, 6) AS value FROM b JOIN u USING (kind, batch) WHERE until IS NULL OR ts < until""")
def best_estimate_of_batches(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "ts", "value", (F.col("event_id") % 3).cast("int").alias("batch"))
    e = e.filter(F.date_diff(F.col("ts"), F.lit("2024-01-01").cast("date")) >= F.col("batch") * 7)
    return best_estimate(e, "batch", "ts", ["kind"]).select("event_id", "kind", "batch", r6("value").alias("value"))


# times


@query("""SELECT event_id, date_trunc('hour', ts) - INTERVAL (hour(ts) % 6) HOUR AS floor6h, date_trunc('minute', ts) - INTERVAL (minute(ts) % 15) MINUTE AS floor15m,
  round(date_diff('microsecond', TIMESTAMP '1950-01-01', ts) / 86400000000.0::DOUBLE, 6) AS julian, CAST(dayofyear(ts) AS INT) AS day_of_year, ts + INTERVAL 1 MONTH AS next_month,
  strftime(ts, '%Y/%m/%d %H:%M:%S') AS text, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN 0 WHEN ts < TIMESTAMP '2024-01-10' THEN -1 ELSE 1 END AS place
  FROM events""")
def time_functions(spark, d):
    ts, at = F.col("ts"), lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "events").select(
        "event_id", times.round_date(ts, "hour", 6, "floor").alias("floor6h"), times.round_date(ts, "minute", 15, "floor").alias("floor15m"), r6(times.julian_day(ts)).alias("julian"),
        F.dayofyear(ts).alias("day_of_year"), times.add_time(ts, 1, "month").alias("next_month"), times.to_text(ts, "%Y/%m/%d %H:%M:%S").alias("text"),
        times.in_range(ts, at("2024-01-10"), at("2024-01-20")).alias("place"),
    )


@query("""SELECT * FROM (SELECT o_orderkey, greatest(o_orderdate, TIMESTAMP '1997-01-01') AS lo, least(o_orderdate + INTERVAL 90 DAY, TIMESTAMP '1998-01-01') AS hi FROM orders) WHERE lo < hi""")
def interval_intersection(spark, d):
    o = table(spark, d, "orders")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    both = times.intersect((F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 90 day")), (at("1997-01-01"), at("1998-01-01")))
    return o.select("o_orderkey", both.alias("b")).filter("b is not null").select("o_orderkey", "b.lo", "b.hi")


@query("""SELECT kind, lo, least(lo + INTERVAL 7 DAY, hi) AS hi FROM (SELECT event_type AS kind, date_trunc('day', max(ts)) AS hi, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) - INTERVAL 1 SECOND, INTERVAL 7 DAY)) AS lo FROM events GROUP BY 1)""")
def split_interval(spark, d):
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    ends = table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(day(F.min("ts")).alias("a"), day(F.max("ts")).alias("b"))
    return ends.select("kind", F.explode(times.split(F.col("a"), F.col("b"), 7, "day")).alias("p")).select("kind", "p.lo", "p.hi")


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate) AS start, count(*) AS n FROM orders GROUP BY 1)
  SELECT start, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(start), max(start), INTERVAL 1 MONTH)) AS start FROM c) LEFT JOIN c USING (start)""")
def cast_histogram(spark, d):
    return prof.histogram(table(spark, d, "orders"), "o_orderdate", "month")


@query(with_("series", """&p AS (SELECT kind, date_diff('second', TIMESTAMP '2024-01-01', t)::DOUBLE + 600 AS x, v FROM series), h AS (SELECT kind, unnest(generate_series(CAST(ceil(min(x) / 3600) AS BIGINT), CAST(floor(max(x) / 3600) AS BIGINT))) * 3600.0::DOUBLE AS x FROM p GROUP BY kind),
  l AS (SELECT h.kind, h.x, p.x AS lx, p.v AS lv FROM h ASOF LEFT JOIN p ON h.kind = p.kind AND h.x >= p.x), b AS (SELECT l.*, p.x AS hx, p.v AS hv FROM l ASOF LEFT JOIN p ON l.kind = p.kind AND l.x <= p.x)
  SELECT kind, x, round(CASE WHEN x = lx THEN lv WHEN x = hx THEN hv ELSE lv + (hv - lv) * (x - lx) / (hx - lx) END, 6) AS value FROM b"""))
def exact_hours(spark, d):
    """Values on the hour of a series that is ten minutes late."""
    x = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("t")) + F.lit(600.0)
    src = series(spark, d).select("kind", x.alias("x"), "v")
    ends = src.groupBy("kind").agg(F.ceil(F.min("x") / 3600).alias("a"), F.floor(F.max("x") / 3600).alias("b"))
    hours = ends.select("kind", F.explode(F.sequence("a", "b")).alias("h")).select("kind", (F.col("h") * 3600.0).alias("x"))
    return interp.interp1d(src, hours, ["kind"], "x", "v").select("kind", "x", r6("value").alias("value"))


@query("""SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris' AS paris, ts - INTERVAL 2 DAY AS lo, ts + INTERVAL 2 DAY AS hi,
  CASE WHEN ts = date_trunc('day', ts) THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS inner_lo FROM events""")
def zones_and_margins(spark, d):
    ts = F.col("ts")
    margin, inner = times.add_margin(ts, ts, 2, "day"), times.round_interval(ts, times.add_time(ts, 5, "day"), "day")
    return table(spark, d, "events").select("event_id", times.zone_to_zone(ts, "UTC", "Europe/Paris").alias("paris"), margin["lo"].alias("lo"), margin["hi"].alias("hi"), inner["lo"].alias("inner_lo"))
