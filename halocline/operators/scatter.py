"""Scattered points to other points and to grids: linear on Delaunay triangles, nearest, and what a grid lacks.

A target's triangle is found among its nearest points. It is the triangle of the whole set if no point lies in its
circle; the point nearest to the circle's centre tells. Where the circle reaches beyond what the target has met, its
centre asks for its own nearest points, and the triangle is found anew with these, until it stays. A target outside the
hull of all points is in a triangle with a far corner, whose circle is as good as a half plane, and is told the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.operators import points as pts
from halocline.operators.cut import Steps
from halocline.operators.neighbours import Quadtree, k_nearest
from halocline.operators.stats import quantiles


FAR = np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0]])  # where the three corners lie that stand for outside


def enclosing(x: np.ndarray, y: np.ndarray, far: float, rounds: int = 200) -> tuple[np.ndarray, ...]:
    """For each row of points (nan: none) the corners of the Delaunay triangle around the origin, their weights at it, and
    the triangle's circle (centre x, y and radius, nan if it is none). Corners from the number of columns on are far ones.

    On the paraboloid x^2 + y^2 the triangle is the facet below the origin: from any triangle around it the point
    farthest below its plane replaces one of the corners, until none is below. Three corners, far and raised, begin.
    """
    rows, n = x.shape
    px, py = (np.concatenate([v, np.tile(FAR[:, i] * far, (rows, 1))], 1) for i, v in enumerate((x, y)))
    lifted = np.concatenate([x * x + y * y, np.full((rows, 3), 4.0 * far**2)], 1)
    tri, rest = np.tile([n, n + 1, n + 2], (rows, 1)), np.arange(rows)

    def at(v: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(v[r, t[:, k]] for k in range(3))

    def weights(r: np.ndarray, t: np.ndarray) -> np.ndarray:
        (ax, bx, cx), (ay, by, cy) = at(px, r, t), at(py, r, t)
        det = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
        det = np.where(det == 0, np.nan, det)
        u, v = ((cx - ax) * ay - ax * (cy - ay)) / det, (ax * (by - ay) - (bx - ax) * ay) / det
        return np.stack([1 - u - v, u, v], 1)

    def plane(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slopes, and height at the origin, of the plane through the three lifted corners."""
        (ax, bx, cx), (ay, by, cy), (az, bz, cz) = at(px, r, t), at(py, r, t), at(lifted, r, t)
        det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        sx, sy = ((bz - az) * (cy - ay) - (by - ay) * (cz - az)) / det, ((bx - ax) * (cz - az) - (bz - az) * (cx - ax)) / det
        return sx, sy, az - sx * ax - sy * ay

    with np.errstate(all="ignore"):
        for _ in range(rounds):
            t = tri[rest]
            sx, sy, z = plane(rest, t)
            below = sx[:, None] * x[rest] + sy[:, None] * y[rest] + z[:, None] - lifted[rest, :n]
            below = np.where(np.isnan(below), -np.inf, below)
            worst = below.argmax(1)
            here = np.arange(len(rest))
            scale = 1e-12 * (np.abs(lifted[rest, worst]) + np.abs(z) + np.abs(sx * x[rest, worst]) + np.abs(sy * y[rest, worst]) + 1e-300)
            go = (below[here, worst] > scale) & (t != worst[:, None]).all(1)
            rest, t, worst = rest[go], t[go], worst[go]
            if not len(rest):
                break
            best, inner = None, np.full(len(rest), -np.inf)
            for k in range(3):  # of the three triangles with the new corner the one that holds the origin
                new = t.copy()
                new[:, k] = worst
                least = np.nan_to_num(weights(rest, new).min(1), nan=-np.inf)
                better = least > inner
                best = new if best is None else np.where(better[:, None], new, best)
                inner = np.where(better, least, inner)
            tri[rest] = best
        every = np.arange(rows)
        sx, sy, z = plane(every, tri)
        return tri, weights(every, tri), sx / 2, sy / 2, np.sqrt(z + (sx * sx + sy * sy) / 4)


def linear(points: DataFrame, targets: DataFrame, key: str, near: int = 24, x: str = "x", y: str = "y", value: str = "z", more: int = 8, batch: int = 4096) -> DataFrame:
    """Values of ``points`` at ``targets`` (key, x, y), linear on the Delaunay triangles of the points: key, value.

    Targets outside the hull are null, and so are those without a position. Points without a value do not count, those
    at one place as their mean. A target meets its ``near`` nearest points and, in each further round, the ``more`` that
    are nearest to its circle's centre, wherever they are; no task holds more than those of its targets. Targets at one
    place ask once.
    """
    p = points.filter(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    p = p.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.avg(value).alias("z")).withColumn("place", F.struct("x", "y"))
    tree = Quadtree(p, "place", near, depth=None, carry=["z"])
    steps = Steps(points.sparkSession, "linear")
    t = targets.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    placed = steps.write(t.filter("x is not null and y is not null").select(F.struct("x", "y").alias("key"), "x", "y").distinct())
    if tree.n < 3 or placed.isEmpty():
        return t.select(F.col("key").alias(key), F.lit(None).cast("double").alias("value"))
    ends = placed.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, y0 = tree.corner
    far = 1e4 * (tree.wide + max(ends[1], x0 + tree.wide) - min(ends[0], x0) + max(ends[3], y0 + tree.wide) - min(ends[2], y0))
    state = "x double, y double, met array<struct<x:double,y:double,z:double>>, known double, value double, cx double, cy double, sure boolean"
    schema = "key struct<x:double,y:double>, " + state

    def solve(batches):
        for rows in (b.iloc[i : i + batch] for b in batches for i in range(0, len(b), batch)):
            tx, ty = rows["x"].to_numpy(), rows["y"].to_numpy()
            lists = [np.array([(v["x"], v["y"], v["z"]) for v in m]).reshape(-1, 3) for m in rows["met"]]
            found = np.full((len(rows), max(map(len, lists)), 3), np.nan)
            for i, m in enumerate(lists):
                found[i, : len(m)] = m
            tri, w, cx, cy, r = enclosing(found[:, :, 0] - tx[:, None], found[:, :, 1] - ty[:, None], far)
            n = found.shape[1]
            # a target on a side of the hull has no part in the far corner beyond it
            idle = (tri >= n) & (np.abs(w) < 1e-9)
            within = ((tri < n) | idle).all(1) & (w.min(1) >= -1e-9)
            z = np.where(idle | (tri >= n), 0.0, np.take_along_axis(found[:, :, 2], np.minimum(tri, n - 1), 1))
            known = rows["known"].to_numpy()
            same = (np.abs(cx + tx - rows["cx"].to_numpy()) <= 1e-9 * r) & (np.abs(cy + ty - rows["cy"].to_numpy()) <= 1e-9 * r)
            sure = same | (np.hypot(cx, cy) + r <= known)
            yield rows.assign(value=np.where(within, (np.where(idle, 0.0, w) * z).sum(1), np.nan), cx=cx + tx, cy=cy + ty, sure=sure)

    met = F.array_sort(F.collect_list(F.struct("x", "y", F.col("of_z").alias("z")))).alias("new")
    first = tree.nearest(placed, "key", near).groupBy("target").agg(met, F.max("distance").alias("known"), F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("n") < min(near, tree.n) + (tree.n <= near), F.lit(float("inf"))).otherwise(F.col("known"))
    nought = {c: F.lit(None).cast("double") for c in ("value", "cx", "cy")} | {"sure": F.lit(False)}
    rest = placed.join(first.select(F.col("target").alias("key"), F.col("new").alias("met"), known.alias("known")), "key").withColumns(nought)
    out = None
    while True:
        columns = ["key", "x", "y", "met", "known", "value", "cx", "cy", "sure"]
        solved = steps.write(rest.select(*columns).mapInPandas(solve, schema))
        part = solved.filter("sure").select("key", "value")
        out = part if out is None else out.unionByName(part)
        open_ = solved.filter("not sure")
        if open_.isEmpty():
            break
        asked = tree.nearest(open_, "key", more, "cx", "cy").groupBy("target").agg(met)
        rest = open_.join(asked.withColumnRenamed("target", "key"), "key").withColumn("met", F.array_distinct(F.concat("met", "new"))).drop("new")
    out = out.select("key.x", "key.y", F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return t.join(out, ["x", "y"], "left").select(F.col("key").alias(key), "value")


def nearest_value(points: DataFrame, point_key: str, targets: DataFrame, key: str, size: float, x: str = "x", y: str = "y", value: str = "z") -> DataFrame:
    """The value of the point nearest to each target: key, value; of equally near points the one with the smaller key."""
    valid = points.filter(F.col(value).isNotNull())
    found = pts.nearest(targets, key, valid, point_key, size, x, y, geo=False, out="_point")
    return found.join(valid.select(F.col(point_key).alias("_point"), F.col(value).cast("double").alias("value")), "_point").select(key, "value")


def grid_over(points: DataFrame, step: float, x: str = "x", y: str = "y") -> DataFrame:
    """A regular grid of ``step`` that holds all points: j, i, x, y, counted from the lower left."""
    ends = points.agg(*[f(c).cast("double").alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a, c in (("x", x), ("y", y))])
    count = lambda a: F.sequence(F.lit(0), F.ceil((F.col(f"hi{a}") - F.col(f"lo{a}")) / step).cast("int"))
    rows = ends.withColumn("j", F.explode(count("y"))).withColumn("i", F.explode(count("x")))
    return rows.select("j", "i", (F.col("lox") + F.col("i") * step).alias("x"), (F.col("loy") + F.col("j") * step).alias("y"))


def to_grid(points: DataFrame, grid: DataFrame, size: float, method: str = "linear", x: str = "x", y: str = "y", value: str = "z", point_key: str = "id") -> DataFrame:
    """Scattered points on a grid (j, i, x, y): j, i, value; ``linear`` or ``nearest``."""
    cells = grid.select("j", "i", F.struct("j", "i").alias("_cell"), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y))
    found = linear(points, cells, "_cell", x=x, y=y, value=value) if method == "linear" else nearest_value(points, point_key, cells, "_cell", size, x, y, value)
    return found.select("_cell.j", "_cell.i", "value")


def fill2d(field: DataFrame, value: str, size: float = 3.0, method: str = "linear") -> DataFrame:
    """A field (j, i, value) whose null cells are filled from those that are not, by index: linear on triangles, and
    ``nearest`` also beyond the hull of the valid cells. ``size``: side of the squares tried first, in cells."""
    at = field.select("j", "i", F.struct("j", "i").alias("cell"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), F.col(value).cast("double").alias("z"))
    holes = at.filter("z is null").drop("z")
    found = linear(at, holes, "cell") if method == "linear" else nearest_value(at, "cell", holes, "cell", size)
    joined = at.join(found.withColumnRenamed("value", "_found"), "cell", "left")
    return joined.select("j", "i", F.coalesce("z", "_found").alias(value))


def spacing(points: DataFrame, key: str, size: float, x: str = "x", y: str = "y", accuracy: int = 10_000) -> DataFrame:
    """The median distance of points from their nearest neighbour at another place: one row, spacing, the lower one of an
    even number, found in ``accuracy`` slices of the distances. Points that have none in the squares of side ``size``
    around them do not count.

    A neighbour nearer than ``size`` is in these squares, and is found by a quadtree. Points that have none so near are
    few to a square, and look through theirs.
    """
    steps = Steps(points.sparkSession, "spacing")
    at = steps.write(points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null").distinct().withColumn("k", F.struct("x", "y")))
    two = steps.write(k_nearest(at, "k", at.withColumn("place", F.col("k")), "place", 2).filter("place != k").groupBy("k").agg(F.min("distance").alias("d")))
    eight = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    alone = two.filter(F.col("d") >= size).select("k", "k.x", "k.y")
    near = alone.withColumn("s", F.explode(eight)).select("k", "x", "y", (cell("x") + F.col("s.a")).alias("cx"), (cell("y") + F.col("s.b")).alias("cy"))
    other = at.select(F.col("x").alias("ox"), F.col("y").alias("oy"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    far = near.join(other, ["cx", "cy"]).filter((F.col("x") != F.col("ox")) | (F.col("y") != F.col("oy"))).groupBy("k").agg(F.min(d).alias("d"))
    counted = steps.write(two.filter(F.col("d") < size).unionByName(far).groupBy("d").agg(F.count(F.lit(1)).alias("n")))
    return quantiles(counted, "d", "n", [0.5], accuracy, steps).agg(F.first("value").alias("spacing"))
