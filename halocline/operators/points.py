"""Points, polygons and what joins them: nearest neighbours, point in polygon, overlay, duplicates, thinning.

Nearest neighbours are found through coarse cells: a point and its candidates meet in one cell, so the join is an
equi-join. Polygons are arrays of struct<x, y>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.functions.geo import haversine, inverse_mercator, mercator, planar
from halocline.functions.units import EARTH_RADIUS
from halocline.operators.cut import Steps


CROWD = 16  # targets that a cell may hold where a search begins


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def nearest(points: DataFrame, key: str, targets: DataFrame, target_key: str, size: float, x: str = "lon", y: str = "lat", rings: int = 1, geo: bool = True, out: str = "nearest") -> DataFrame:
    """For each point the closest target: key, target_key as ``out``, distance. Of equal distances the smaller key.

    The cells ``rings`` around a point's are searched first; their side is ``size``, degrees if ``geo``. A point is
    settled if its best candidate is no farther than the ring reaches; for those that are not the search goes on with
    cells three times as wide, up to the whole: one target of each inner cell bounds the distance, and only inner cells
    that may hold a nearer one are opened. On the sphere cells are cubes around the unit sphere, which know
    neither poles nor date line. Points and targets without a position are left out, the latter as candidates.

    Points at one place ask once, targets at one place are one, that of the smallest key. Where cells of ``size`` hold
    more than ``CROWD`` targets in the mean over targets, the search begins with smaller ones.
    """
    steps = Steps(points.sparkSession, "nearest")
    every = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))
    p = steps.write(every.select("_px", "_py").distinct())
    t = targets.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(target_key).alias("_t"), F.col(x).cast("double").alias("_tx"), F.col(y).cast("double").alias("_ty"))
    t = steps.write(t.groupBy("_tx", "_ty").agg(F.min("_t").alias("_t")))
    if geo:
        distance, place = haversine(F.col("_px"), F.col("_py"), F.col("_tx"), F.col("_ty")), _on_sphere
        side, widest = 2 * math.sin(math.radians(min(size, 180.0)) / 2), 2.0
        reach = lambda r: 2 * EARTH_RADIUS * math.asin(min(1.0, r / 2))  # noqa: E731  # of a chord
    else:
        distance, place, side, reach = planar(F.col("_px"), F.col("_py"), F.col("_tx"), F.col("_ty")), lambda a, b: [a, b], size, lambda r: r
        span = p.select("_px", "_py").union(t.select("_tx", "_ty")).agg(F.max("_px") - F.min("_px"), F.max("_py") - F.min("_py")).first()
        widest = max(span[0] or 0.0, span[1] or 0.0)
    axes = range(3 if geo else 2)
    line = (lambda d: 2 * F.sin(d / (2 * EARTH_RADIUS))) if geo else (lambda d: d)  # through the sphere
    done, around, level = None, F.sequence(F.lit(-rings), F.lit(rings)), 0
    on = [f"_c{k}" for k in axes]
    while side > widest * 1e-6:
        held = t.groupBy(*[F.floor(c / side).cast("long").alias(on[k]) for k, c in enumerate(place(F.col("_tx"), F.col("_ty")))]).agg(F.count(F.lit(1)).alias("n"))
        if (held.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0) <= CROWD:
            break
        side /= 3
    while True:
        wide = 3 if level else 1  # later cells are three cells of the level before each way
        fine = lambda a, b: [F.floor(c / (side / wide)).cast("long") for c in place(F.col(a), F.col(b))]  # noqa: E731,B023
        coarse = lambda a, b: [F.floor(c / wide).cast("long") for c in fine(a, b)]  # noqa: E731,B023
        last = side * rings >= widest
        cells = p
        for k in axes:
            cells = cells.withColumn(f"_d{k}", F.explode(around))
        cells = cells.select("_px", "_py", *[(c + F.col(f"_d{k}")).alias(f"_c{k}") for k, c in enumerate(coarse("_px", "_py"))])
        there = t.withColumns({f"_f{k}": c for k, c in enumerate(fine("_tx", "_ty"))})
        if level:
            # of the inner cells around a point those that may hold what is nearer than one target of each
            held = there.groupBy(*[f"_f{k}" for k in axes]).agg(F.min(F.struct("_t", "_tx", "_ty")).alias("_one"))
            held = held.select("*", "_one._tx", "_one._ty", *[F.floor(F.col(f"_f{k}") / wide).cast("long").alias(f"_c{k}") for k in axes])
            least = F.lit(0.0)
            for k, c in enumerate(place(F.col("_px"), F.col("_py"))):
                lo = F.col(f"_f{k}") * (side / wide)
                gap = F.greatest(lo - c, c - lo - side / wide, F.lit(0.0))
                least = least + gap * gap
            near = cells.join(held, on).withColumns({"_least": F.sqrt(least), "_most": F.min(line(distance)).over(W.partitionBy("_px", "_py"))})
            near = near.filter(F.col("_least") <= F.col("_most") * (1 + 1e-9)).select("_px", "_py", *[f"_f{k}" for k in axes])
            found = near.join(there, [f"_f{k}" for k in axes])
        else:
            found = cells.join(there.select("_t", "_tx", "_ty", *[F.col(f"_f{k}").alias(f"_c{k}") for k in axes]), on)
        best = steps.write(found.groupBy("_px", "_py").agg(F.min(F.struct(distance.alias("d"), F.col("_t").alias("t"))).alias("b")))
        sure = best if last else best.filter(F.col("b.d") <= reach(side * rings))
        part = sure.select("_px", "_py", F.col("b.t").alias(out), F.col("b.d").alias("distance"))
        done = part if done is None else done.unionByName(part)
        if last:
            break
        p = steps.write(p.join(sure.select("_px", "_py"), ["_px", "_py"], "left_anti"))
        if p.isEmpty():
            break
        side, level = side * 3, level + 1
    return every.join(done, ["_px", "_py"]).select(key, out, "distance")


def _on_sphere(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


def distances(a: DataFrame, b: DataFrame, key: str, geo: bool = True) -> DataFrame:
    """Between rows of equal ``key``: key, distance; a and b have lon and lat."""
    joined = a.select(key, F.col("lon").alias("x1"), F.col("lat").alias("y1")).join(b.select(key, F.col("lon").alias("x2"), F.col("lat").alias("y2")), key)
    f = haversine if geo else planar
    return joined.select(key, f(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("distance"))


def polygon(vertices: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in vertices])


def inside(x: Column, y: Column, vertices: Column) -> Column:
    """Even-odd rule; a point on an upper or right edge is outside."""
    n = F.size(vertices)

    def step(acc: Column, k: Column) -> Column:
        a, b = F.element_at(vertices, k), F.element_at(vertices, k % n + 1)
        crosses = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return acc != crosses

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(False), step)


def area(vertices: Column) -> Column:
    """Of a simple polygon, without sign."""
    n = F.size(vertices)

    def step(acc: Column, k: Column) -> Column:
        a, b = F.element_at(vertices, k), F.element_at(vertices, k % n + 1)
        return acc + (a["x"] * b["y"] - b["x"] * a["y"])

    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), step)) / 2


def select(df: DataFrame, shapes: list[list[tuple[float, float]]], x: str = "lon", y: str = "lat", reverse: bool = False) -> DataFrame:
    """Rows inside any of a few polygons, or outside all; a box around each comes first, which the scan can use."""
    hit = F.lit(False)
    for s in shapes:
        xs, ys = [v[0] for v in s], [v[1] for v in s]
        box = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
        hit = hit | (box & inside(F.col(x), F.col(y), polygon(s)))
    return df.filter(~hit if reverse else hit)


def clip_box(vertices: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The part of a polygon within (xmin, ymin, xmax, ymax), side by side."""
    xmin, ymin, xmax, ymax = box
    for axis, limit, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        kept: list[tuple[float, float]] = []
        for a, b in zip(vertices, vertices[1:] + vertices[:1], strict=True):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina:
                kept.append(a)
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                kept.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        vertices = kept
        if not vertices:
            break
    return vertices


def polygon_area_in(vertices: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Area of the part of a polygon that lies in a box; the polygon is cut side by side, which is exact for convex
    polygons, and for others but for slivers without width."""
    for axis, limit, sign in (("x", xmin, 1), ("x", xmax, -1), ("y", ymin, 1), ("y", ymax, -1)):
        vertices = _once(vertices, _cutter(axis, limit, sign))
    return _once(vertices, lambda v: F.when(F.size(v) > 2, area(v)).otherwise(0.0))


def _once(value: Column, use) -> Column:
    """``use(value)``, the value worked out once though it may stand in it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cutter(axis: str, limit: Column, sign: int):
    return lambda vertices: _cut_side(vertices, axis, limit, sign)


def _cut_side(vertices: Column, axis: str, limit: Column, sign: int) -> Column:
    other = "y" if axis == "x" else "x"
    n = F.size(vertices)
    none = F.lit(None).cast("struct<x:double,y:double>")

    def piece(k: Column) -> Column:
        a, b = F.element_at(vertices, k), F.element_at(vertices, k % n + 1)
        in_a, in_b = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
        t = (limit - a[axis]) / (b[axis] - a[axis])
        crossing = {axis: limit.cast("double"), other: a[other] + t * (b[other] - a[other])}
        cross = F.struct(*[crossing[c].alias(c) for c in ("x", "y")])
        own = F.struct(*[a[c].alias(c) for c in ("x", "y")])
        return F.array(F.when(in_a, own).otherwise(none), F.when(in_a != in_b, cross).otherwise(none))

    cut = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), n), piece)), lambda v: v.isNotNull())
    return F.when(n > 0, cut).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def polygon_mask(cells: DataFrame, shapes: list[list[tuple[float, float]]], dx: float, dy: float, mode: str = "intersect", thresholds: tuple[float, float] = (0.5, 0.75), x: str = "lon", y: str = "lat",
                 out: str = "mask") -> DataFrame:
    """Whether each cell (centre, dx, dy) is covered by polygons. ``inside``: its centre lies in one; ``intersect``: they
    cover ``thresholds[0]`` of its area, or ``thresholds[1]`` where more than one of them meets the cell."""
    cx, cy = F.col(x), F.col(y)
    if mode == "inside":
        hit = F.lit(False)
        for s in shapes:
            hit = hit | inside(cx, cy, polygon(s))
        return cells.withColumn(out, hit)
    parts = [polygon_area_in(polygon(s), cx - dx / 2, cy - dy / 2, cx + dx / 2, cy + dy / 2) / (dx * dy) for s in shapes]
    counted = cells.withColumn("_parts", F.array(*parts))
    total = F.aggregate("_parts", F.lit(0.0), lambda acc, v: acc + v)
    many = F.size(F.filter("_parts", lambda v: v > 0)) > 1
    return counted.withColumn(out, total >= F.when(many, thresholds[1]).otherwise(thresholds[0])).drop("_parts")


def cover_islands(mask: DataFrame, islands: DataFrame, dx: float, dy: float, least: float = 0.85, most: float = 1.5, reach: int = 2, x: str = "lon", y: str = "lat", land: str = "mask") -> DataFrame:
    """Makes land of the cell that holds most of each island of ``least`` to ``most`` of a cell's area. islands: shape
    (array of vertices); mask: x, y (centres), land. Islands meet the cells ``reach`` around them by square; of cells with
    equal parts the first by y, then x."""
    at = islands.withColumns({"_a": area(F.col("shape")), "_id": F.xxhash64("shape")}).filter(F.col("_a").between(dx * dy * least, dx * dy * most))
    mid = lambda c: (F.array_min(F.transform("shape", lambda v: v[c])) + F.array_max(F.transform("shape", lambda v: v[c]))) / 2
    around = F.sequence(F.lit(-reach), F.lit(reach))
    near = at.withColumn("_cx", _cell(mid("x"), dx)).withColumn("_cy", _cell(mid("y"), dy)).withColumn("_a1", F.explode(around)).withColumn("_b1", F.explode(around))
    near = near.select("_id", "shape", (F.col("_cx") + F.col("_a1")).alias("_cx"), (F.col("_cy") + F.col("_b1")).alias("_cy"))
    cells = mask.select(F.col(x).alias("_x"), F.col(y).alias("_y"), _cell(F.col(x), dx).alias("_cx"), _cell(F.col(y), dy).alias("_cy"))
    part = polygon_area_in(F.col("shape"), F.col("_x") - dx / 2, F.col("_y") - dy / 2, F.col("_x") + dx / 2, F.col("_y") + dy / 2)
    best = cells.join(near, ["_cx", "_cy"]).withColumn("_part", part).groupBy("_id").agg(F.min(F.struct((-F.col("_part")).alias("p"), F.col("_y").alias("y"), F.col("_x").alias("x"))).alias("b"))
    forced = best.filter("b.p < 0").select(F.col("b.x").alias("_x"), F.col("b.y").alias("_y"), F.lit(True).alias("_forced")).distinct()
    joined = mask.join(forced, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left")
    return joined.withColumn(land, F.col(land) | F.coalesce("_forced", F.lit(False))).drop("_x", "_y", "_forced")


def open_straits(mask: DataFrame, coastal: str, shapes: list[list[tuple[float, float]]], dx: float, dy: float, threshold: float = 0.75, x: str = "lon", y: str = "lat", land: str = "mask") -> DataFrame:
    """Coastal cells that two or more polygons meet, and that they do not cover by ``threshold``, become water."""
    cx, cy = F.col(x), F.col(y)
    parts = [polygon_area_in(polygon(s), cx - dx / 2, cy - dy / 2, cx + dx / 2, cy + dy / 2) / (dx * dy) for s in shapes]
    counted = mask.withColumn("_parts", F.filter(F.array(*parts), lambda v: v > 0))
    covered = F.aggregate("_parts", F.lit(0.0), lambda acc, v: acc + v) > threshold
    strait = F.col(coastal) & ~covered & (F.size("_parts") >= 2)
    return counted.withColumn(land, F.when(strait, False).otherwise(F.col(land))).drop("_parts")


def mask_fraction(cells: DataFrame, shape: list[tuple[float, float]], dx: float, dy: float, fine: int = 4, x: str = "lon", y: str = "lat", out: str = "fraction") -> DataFrame:
    """Share of each cell (centre, dx, dy) in a polygon, of fine x fine points."""
    steps = [(k + 0.5) / fine - 0.5 for k in range(fine)]
    hits = [inside(F.col(x) + a * dx, F.col(y) + b * dy, polygon(shape)).cast("int") for b in steps for a in steps]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return cells.withColumn(out, total / float(fine * fine))


def overlay(layers: list[DataFrame], hulls: list[list[tuple[float, float]] | None], x: str = "x", y: str = "y") -> DataFrame:
    """Point sets from bottom to top: an opaque set (one with a hull) first removes the points below that its hull holds."""
    out = None
    for layer, hull in zip(layers, hulls, strict=True):
        if out is not None and hull:
            out = select(out, [hull], x, y, reverse=True)
        out = layer if out is None else out.unionByName(layer)
    return out


def duplicates(casts: DataFrame, order: str, platform: str, ts: str, corrupted: str, same: list[str], max_hours: float = 12.0) -> DataFrame:
    """Adds ``duplicate``: another cast of the same platform and place has the same time, or, if either time is
    corrupted, one within ``max_hours``; and is preferred: a sound time first, then the lower ``order``.

    Casts of one platform and place are sorted by time once: a cast needs the most preferred among those near it in
    time, which a window by time holds; no pairs are made.
    """
    keys = [F.upper(F.trim(F.col(platform))), *[F.col(c) for c in same]]
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    rank = F.struct(F.col(corrupted).cast("int").alias("bad"), F.col(order).alias("o"))
    rows = casts.withColumns({"_s": seconds, "_rank": rank})
    near = W.partitionBy(*keys).orderBy("_s").rangeBetween(-int(max_hours * 3600), int(max_hours * 3600))
    equal = W.partitionBy(*keys).orderBy("_s").rangeBetween(0, 0)
    best_near, best_equal = F.min("_rank").over(near), F.min("_rank").over(equal)
    # a corrupted cast loses to any preferred one near it; a sound one only to one at its own time
    lost = F.when(F.col(corrupted), best_near < F.col("_rank")).otherwise(best_equal < F.col("_rank"))
    return rows.withColumn("duplicate", lost).drop("_s", "_rank")


def thin(df: DataFrame, key: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """One point a square of side ``radius``: the one nearest the middle of the square, of equal ones the lower key."""
    cx, cy = _cell(F.col(x), radius), _cell(F.col(y), radius)
    off = planar(F.col(x), F.col(y), (cx + 0.5) * radius, (cy + 0.5) * radius)
    best = df.groupBy(cx.alias("_cx"), cy.alias("_cy")).agg(F.min(F.struct(off.alias("d"), F.col(key).alias("k"))).alias("b"))
    return df.join(best.select(F.col("b.k").alias(key)), key, "left_semi")


def box_of(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def great_circle(n: int, lon1: float, lat1: float, lon2: float, lat2: float, spark) -> DataFrame:
    """n + 1 points from one to the other on the great circle: k, lon, lat."""
    a, b = [(math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)), math.sin(math.radians(la))) for lo, la in ((lon1, lat1), (lon2, lat2))]
    angle = math.acos(max(-1.0, min(1.0, sum(p * q for p, q in zip(a, b, strict=True)))))
    t = F.col("k") / float(n)
    wa, wb = (1 - t, t) if angle < 1e-12 else (F.sin((1 - t) * angle) / math.sin(angle), F.sin(t * angle) / math.sin(angle))
    px, py, pz = [wa * p + wb * q for p, q in zip(a, b, strict=True)]
    return spark.range(n + 1).withColumnRenamed("id", "k").select("k", F.degrees(F.atan2(py, px)).alias("lon"), F.degrees(F.asin(pz)).alias("lat"))


def shape_table(df: DataFrame, shape: str = "shape", geo: bool = False) -> DataFrame:
    """Polygons (array of struct<x, y>) with n, area and the box xmin, ymin, xmax, ymax; ``geo``: areas in square
    metres, of x and y in degrees, each polygon on a plane that touches at its middle."""
    v = F.col(shape)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    ends = {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}
    size = area(v)
    if geo:
        metre = math.pi * EARTH_RADIUS / 180
        size = size * metre * metre * F.cos(F.radians((F.array_min(ys) + F.array_max(ys)) / 2))
    return df.withColumns({"n": F.size(v), "area": size, **ends})


def largest_shapes(df: DataFrame, n: int, shape: str = "shape", geo: bool = False) -> DataFrame:
    """The ``n`` polygons of the greatest area, the greatest first."""
    return shape_table(df, shape, geo).orderBy(F.desc("area")).limit(n)


def projected(df: DataFrame, shape: str = "shape", inverse: bool = False) -> DataFrame:
    """Polygons on the Mercator plane in metres, or back in degrees."""
    def move(p: Column) -> Column:
        x, y = inverse_mercator(p["x"], p["y"]) if inverse else mercator(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return df.withColumn(shape, F.transform(shape, move))


def side_length(df: DataFrame, shape: str = "shape", accuracy: int = 10_000) -> DataFrame:
    """Median length of the polygons' sides: one row, resolution."""
    v, n = F.col(shape), F.size(shape)
    ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.element_at(v, k).alias("a"), F.element_at(v, k % n + 1).alias("b")))
    sides = df.select(F.explode(ends).alias("s"))
    return sides.agg(F.percentile_approx(planar(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y")), 0.5, accuracy).alias("resolution"))


def shape_points(df: DataFrame, key: str, shape: str = "shape") -> DataFrame:
    """Corners of polygons as rows: key, n, x, y."""
    return df.select(key, F.posexplode(shape).alias("n", "p")).select(key, "n", "p.x", "p.y")


def clip_shapes(df: DataFrame, box: tuple[float, float, float, float], shape: str = "shape") -> DataFrame:
    """The parts of polygons within (xmin, ymin, xmax, ymax), cut side by side; polygons outside are left out."""
    v = F.col(shape)
    for axis, limit, sign in (("x", box[0], 1), ("x", box[2], -1), ("y", box[1], 1), ("y", box[3], -1)):
        v = _once(v, _cutter(axis, F.lit(float(limit)), sign))
    return df.withColumn(shape, v).filter(F.size(shape) > 2)


def mask_land(field: DataFrame, value: str, shapes: list[list[tuple[float, float]]], dx: float, dy: float, x: str = "lon", y: str = "lat", reverse: bool = False, **how) -> DataFrame:
    """A bathymetry, or any field of cells, that is null where polygons of land cover it (or do not, with ``reverse``);
    ``how`` as for ``polygon_mask``."""
    told = polygon_mask(field, shapes, dx, dy, x=x, y=y, out="_land", **how)
    land = ~F.col("_land") if reverse else F.col("_land")
    return told.withColumn(value, F.when(~land, F.col(value))).drop("_land")
