"""Lines and what lies along them: positions of points on polylines, values between stations of a coast, and sections
through curvilinear grids.

A polyline is rows (line, n, x, y) of its corners in order. Points and segments meet in squares as wide as the reach
within which a point may belong to a line; places on a line are told by the length from its first corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.functions.geo import in_quadrangle
from halocline.operators.overlaps import signed_area

_LINES: dict[str, object] = {}


def register_shoreline(name: str, reader) -> None:
    """Names a reader (spark, **options) -> DataFrame of polylines."""
    _LINES[name] = reader


def shoreline(spark, what, **options) -> DataFrame:
    """A table of polylines as it is, or that of a registered name; raises KeyError for others."""
    return what if isinstance(what, DataFrame) else _LINES[what](spark, **options)


def measured(lines: DataFrame, line: str = "line", n: str = "n", x: str = "x", y: str = "y") -> DataFrame:
    """line, n, x, y and s, the length from the line's first corner. Corners without a place are passed over."""
    w = W.partitionBy("line").orderBy("n")
    rows = lines.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(line).alias("line"), F.col(n).alias("n"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.withColumn("_d", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0)))
    return rows.withColumn("s", F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def along(points: DataFrame, key: str, lines: DataFrame, reach: float, x: str = "x", y: str = "y") -> DataFrame:
    """For each point the nearest place on a line: key, line, s, distance. Points farther than ``reach`` from all lines
    have no row; of equally near lines the smaller counts, and the smaller s. ``lines`` as ``measured`` gives them."""
    w = W.partitionBy("line").orderBy("n")
    segments = lines.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).filter("bx is not null")
    square = lambda c: F.floor(c / reach).cast("long")
    for c in ("x", "y"):
        lo, hi = F.least(c, f"b{c}"), F.greatest(c, f"b{c}")
        segments = segments.withColumn(f"q{c}", F.explode(F.sequence(square(lo) - 1, square(hi) + 1)))
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("_key"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    met = p.withColumns({"qx": square(F.col("px")), "qy": square(F.col("py"))}).join(segments, ["qx", "qy"])
    dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    length = F.hypot(dx, dy)
    share = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / (length * length)))).otherwise(0.0)
    met = met.withColumn("_f", share).withColumn("distance", F.hypot(F.col("px") - F.col("x") - F.col("_f") * dx, F.col("py") - F.col("y") - F.col("_f") * dy)).filter(F.col("distance") <= reach)
    best = met.groupBy("_key").agg(F.min(F.struct("distance", "line", (F.col("s") + F.col("_f") * length).alias("s"))).alias("b"))
    return best.select(F.col("_key").alias(key), "b.line", "b.s", "b.distance")


def values_along(stations: DataFrame, key: str, value: str, lines: DataFrame, reach: float, extrapolate: bool = True, smooth: bool = False, x: str = "x", y: str = "y", line: str = "line", n: str = "n") -> DataFrame:
    """Values at the corners of lines between the stations on them: line, n, value.

    Stations stand where they are nearest to a line, within ``reach``; several at one place count as their mean. Between
    two stations a value is linear in the length along the line, or with ``smooth`` a cubic that is level at either.
    Beyond the outermost stations theirs stands with ``extrapolate``, else null; so it is on lines without a station.
    """
    corners = measured(lines, line, n, "x", "y")
    placed = along(stations.filter(F.col(value).isNotNull()), key, corners, reach, x, y).join(stations.select(key, F.col(value).cast("double").alias("_v")), key)
    known = placed.groupBy("line", "s").agg(F.avg("_v").alias("_v")).withColumns({"n": F.lit(None).cast(corners.schema["n"].dataType), "here": F.lit(True)})
    both = known.unionByName(corners.select("line", "s", "n", F.lit(None).cast("double").alias("_v"), F.lit(False).alias("here")))
    station = F.when(F.col("here"), F.struct("s", "_v"))
    up, down = W.partitionBy("line").orderBy("s", F.col("here").desc(), "n"), W.partitionBy("line").orderBy(F.col("s").desc(), F.col("here").desc(), "n")
    both = both.withColumns({"_a": F.last(station, True).over(up.rowsBetween(W.unboundedPreceding, 0)), "_b": F.last(station, True).over(down.rowsBetween(W.unboundedPreceding, 0))}).filter("not here")
    share = F.when(F.col("_b.s") > F.col("_a.s"), (F.col("s") - F.col("_a.s")) / (F.col("_b.s") - F.col("_a.s"))).otherwise(0.0)
    share = share * share * (3 - 2 * share) if smooth else share
    between = F.col("_a._v") + share * (F.col("_b._v") - F.col("_a._v"))
    beyond = F.coalesce("_a._v", "_b._v") if extrapolate else F.lit(None).cast("double")
    return both.select(F.col("line").alias(line), F.col("n").alias(n), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between).otherwise(beyond).alias(value))


def coastal_depths(stations: DataFrame, key: str, level: str, lines: DataFrame, reach: float, factor: float = 2.0, **options) -> DataFrame:
    """Soundings along a coast from mean sea levels at stations: line, n, x, y, z, the level times ``factor``."""
    found = values_along(stations, key, level, lines, reach, **options)
    return lines.join(found, ["line", "n"]).select("line", "n", "x", "y", (F.col(level) * factor).alias("z"))


def pieces(lines: DataFrame, grid: DataFrame, size: float) -> DataFrame:
    """Parts of lines within the quadrangles of a curvilinear grid: line, s (of the middle), length, j, i, p, q.

    ``lines`` as ``measured`` gives them; ``grid``: j, i, x, y of its nodes. A quadrangle is named by its node of least
    j and i; p and q place the middle in it, as weights of its nodes along i and j. Quadrangles are convex, and one
    without a node is none. ``size``: side of the squares in which segments and quadrangles meet.
    """
    nodes = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("j") - b).alias("j"), (F.col("i") - a).alias("i")) for k, (b, a) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])
    spread = grid.filter("x is not null and y is not null").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.explode(nodes).alias("n")).select("n.j", "n.i", "n.k", "x", "y")
    quads = spread.groupBy("j", "i").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("c")).filter(F.size("c") == 4)
    ring = F.transform("c", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    quads = quads.withColumn("sides", F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring))
    w = W.partitionBy("line").orderBy("n")
    parts = lines.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).filter("bx is not null and (bx != x or by != y)")
    square = lambda c: F.floor(c / size).cast("long")
    for c in ("x", "y"):
        ends = F.col(f"c.{c}")
        parts = parts.withColumn(f"a{c}", square(F.least(c, f"b{c}"))).withColumn(f"q{c}", F.explode(F.sequence(F.col(f"a{c}"), square(F.greatest(c, f"b{c}")))))
        quads = quads.withColumn(f"g{c}", square(F.array_min(ends))).withColumn(f"q{c}", F.explode(F.sequence(F.col(f"g{c}"), square(F.array_max(ends)))))
    # of the squares that both lie in the first one counts, so that no pair is met twice
    met = parts.join(quads, ["qx", "qy"]).filter("qx = greatest(ax, gx) and qy = greatest(ay, gy)").drop("qx", "qy", "ax", "ay", "gx", "gy")
    dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    corner = lambda k: F.get("c", F.lit(k))

    def cut(span: Column, k: Column) -> Column:
        """What a side leaves of the span of the segment: the part to its left."""
        a, b = F.element_at("sides", k), F.element_at("sides", k % 4 + 1)
        here = (b["x"] - a["x"]) * (F.col("y") - a["y"]) - (b["y"] - a["y"]) * (F.col("x") - a["x"])
        grows = (b["x"] - a["x"]) * dy - (b["y"] - a["y"]) * dx
        low = F.when(grows > 0, -here / grows).when((grows == 0) & (here < 0), 2.0).otherwise(0.0)
        return F.struct(F.greatest(span["t0"], low).alias("t0"), F.least(span["t1"], F.when(grows < 0, -here / grows).otherwise(1.0)).alias("t1"))

    whole = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))
    met = met.withColumn("span", F.aggregate(F.sequence(F.lit(1), F.lit(4)), whole, cut)).select("*", "span.t0", "span.t1").filter("t1 - t0 > 1e-12")
    middle = (F.col("t0") + F.col("t1")) / 2
    long = F.hypot(dx, dy)
    met = met.select("line", (F.col("s") + middle * long).alias("s"), ((F.col("t1") - F.col("t0")) * long).alias("length"), "j", "i", (F.col("x") + middle * dx).alias("mx"), (F.col("y") + middle * dy).alias("my"), "c")
    # a piece along a side lies in two quadrangles, and counts in one
    met = met.groupBy("line", F.round("s", 9).alias("_s")).agg(F.min(F.struct("j", "i", "s", "length", "mx", "my", "c")).alias("b")).select("line", "b.*")
    found = met.withColumn("_at", in_quadrangle(F.col("mx"), F.col("my"), [(corner(k)["x"], corner(k)["y"]) for k in range(4)]))
    return found.select("line", "s", "length", "j", "i", "_at.p", "_at.q")


def along_section(found: DataFrame, field: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Values of a field (by, j, i, values) along ``pieces``: by, line, s, length and values, bilinear in a piece's
    quadrangle; null where a node is null or missing that has weight. Depths, as those of sigma levels, are values."""
    by = by or []
    p, q = F.col("p"), F.col("q")
    product = {(0, 0): (1 - p) * (1 - q), (0, 1): p * (1 - q), (1, 1): p * q, (1, 0): (1 - p) * q}
    weights = F.array(*[F.struct((F.col("j") + b).alias("j"), (F.col("i") + a).alias("i"), w.alias("_weight")) for (b, a), w in product.items()])
    heavy = found.withColumn("_w", F.filter(weights, lambda c: F.abs(c["_weight"]) > 1e-12))
    spread = heavy.select("line", "s", "length", F.size("_w").alias("_n"), F.explode("_w").alias("c")).select("line", "s", "length", "_n", "c.j", "c.i", "c._weight")
    joined = spread.join(field.select(*by, "j", "i", *values), ["j", "i"])
    return joined.groupBy(*by, "line", "s", "length", "_n").agg(*[F.when(F.count(v) == F.col("_n"), F.sum(F.col(v) * F.col("_weight"))).alias(v) for v in values]).drop("_n")
