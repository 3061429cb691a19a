"""The k nearest points of targets, and planes through neighbours.

Points are counted in the squares of a quadtree. All targets go down it together: of the squares that a target still
looks at, the counts of those nearest at their far corner give a distance within which k points lie for certain, and
squares whose near side is beyond are dropped. Only the smallest squares that remain are opened.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.operators.cut import Steps

WIDE = 8  # levels of the tree that are broadcast: 4 to this power squares at most


class Quadtree:
    """Counts of points in halved squares, to find nearest points by. Points without a position are left out.

    ``depth``: how often the square around all points is halved; as often as leaves a few points a square where they are
    even, unless it is given. Of points at one place ``most`` of the smallest keys are kept.
    """

    def __init__(self, points: DataFrame, key: str, most: int, x: str = "x", y: str = "y", depth: int | None = None, carry: list[str] | None = None):
        self.carry = carry or []
        self.steps = Steps(points.sparkSession, "quadtree")
        p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("point"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[F.col(c).alias(f"of_{c}") for c in self.carry])
        p = p.withColumn("same", F.row_number().over(W.partitionBy("x", "y").orderBy("point"))).filter(F.col("same") <= most).drop("same")
        p = self.steps.write(p)
        self.n, x0, x1, y0, y1 = p.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        self.points = p
        if not self.n:
            return
        self.corner, self.wide, self.most = (x0, y0), max(x1 - x0, y1 - y0) * (1 + 1e-9) or 1.0, most
        self.depth = min(24, max(0, math.ceil(math.log(max(1, self.n / most), 4)) + 1)) if depth is None else depth
        side = self.wide / 2**self.depth
        square = [F.least(F.floor((F.col(c) - F.lit(z)) / side), F.lit(2**self.depth - 1)).cast("long").alias(f"c{c}") for c, z in (("x", x0), ("y", y0))]
        self.points = p.select("*", *square)
        leaves = self.points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
        level = F.explode(F.sequence(F.lit(0), F.lit(self.depth)))
        up = [F.call_function("shiftright", F.col(c), F.lit(self.depth) - F.col("level")).alias(c) for c in ("cx", "cy")]
        self.tree = self.steps.write(leaves.withColumn("level", level).groupBy("level", *up).agg(F.sum("n").alias("n")))

    def nearest(self, targets: DataFrame, key: str, k: int, x: str = "x", y: str = "y") -> DataFrame:
        """For each target its ``k`` nearest points, ``most`` at most, or all if there are fewer: target, rank (1, 2, ...),
        point, x, y, distance and of_* of the carried columns. Of equally near points the smaller key comes first."""
        t = targets.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("target"), F.col(x).cast("double").alias("tx"), F.col(y).cast("double").alias("ty"))
        if not self.n:
            return t.join(self.points, F.lit(False)).withColumns({"rank": F.lit(0), "distance": F.lit(0.0)}).drop("tx", "ty")
        near, (x0, y0) = t.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")}), self.corner
        own = W.partitionBy("target")
        for level in range(1, self.depth + 1):
            half = lambda c: F.call_function("shiftright", F.col(c), F.lit(1))
            below = self.tree.filter(F.col("level") == level).select(half("cx").alias("ux"), half("cy").alias("uy"), F.col("cx").alias("bx"), F.col("cy").alias("by"), "n")
            below = F.broadcast(below) if level <= WIDE else below
            met = near.join(below, (F.col("cx") == F.col("ux")) & (F.col("cy") == F.col("uy")))
            met = met.select("target", "tx", "ty", F.col("bx").alias("cx"), F.col("by").alias("cy"), "n", *_reach(self.wide / 2**level, x0, y0, F.col("bx"), F.col("by")))
            met = met.withColumn("held", F.sum("n").over(own.orderBy("far", "cx", "cy").rowsBetween(W.unboundedPreceding, 0)))
            met = met.withColumn("bound", F.min(F.when(F.col("held") >= k, F.col("far"))).over(own))
            near = met.filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).select("target", "tx", "ty", "cx", "cy")
            if level % 6 == 0 and level < self.depth:
                near = self.steps.write(near)
        met = near.join(self.points, ["cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")))
        ranked = met.withColumn("rank", F.row_number().over(own.orderBy("distance", "point"))).filter(F.col("rank") <= k)
        return ranked.select("target", "rank", "point", "x", "y", "distance", *[f"of_{c}" for c in self.carry])


def k_nearest(targets: DataFrame, target_key: str, points: DataFrame, point_key: str, k: int, x: str = "x", y: str = "y", depth: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """For each target its ``k`` nearest points in the plane, or all if there are fewer: target_key, rank (1, 2, ...),
    point_key, distance and the points' columns ``carry``; see ``Quadtree``. Targets without a position are left out."""
    tree = Quadtree(points, point_key, k, x, y, depth, carry)
    found = tree.nearest(targets, target_key, k, x, y)
    return found.select(F.col("target").alias(target_key), "rank", F.col("point").alias(point_key), "distance", *[F.col(f"of_{c}").alias(c) for c in tree.carry])


def _reach(side: float, x0: float, y0: float, cx: Column, cy: Column) -> list[Column]:
    """Least and greatest distance of the target from a square, a hair apart so that rounding drops none."""
    near, far = [], []
    for z, c, t in ((x0, cx, F.col("tx")), (y0, cy, F.col("ty"))):
        lo = F.lit(z) + c * side
        near.append(F.greatest(lo - t, t - lo - side, F.lit(0.0)))
        far.append(F.greatest(F.abs(t - lo), F.abs(t - lo - side)))
    return [(F.hypot(*near) - 1e-9 * side).alias("near"), (F.hypot(*far) + 1e-9 * side).alias("far")]


def _plane(v: list[Column], x: Column, y: Column) -> Column:
    """The plane through three points (x, y, z) at a place; the first one's z where they are in line."""
    a, b, c = v
    ux, uy, uz = b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]
    wx, wy, wz = c["x"] - a["x"], c["y"] - a["y"], c["z"] - a["z"]
    det = ux * wy - uy * wx
    sx, sy = (uz * wy - uy * wz) / det, (ux * wz - uz * wx) / det
    return F.when(det == 0, a["z"]).otherwise(a["z"] + sx * (x - a["x"]) + sy * (y - a["y"]))


def _around(near: Column, order: list[int], x: Column, y: Column, both: bool) -> Column:
    """A plane through the neighbour that is first in ``order`` and one on either side of its line through the place,
    both beyond the place; null if there are none. ``both``: also where that neighbour lies on the lower side."""
    first = F.get(near, F.lit(order[0]))
    early = F.array(*[F.get(near, F.lit(i)) for i in order[1:]])
    others = F.filter(F.concat(early, F.slice(near, len(order) + 1, F.size(near))), lambda v: v.isNotNull())
    dx = first["x"] - x
    slope = (first["y"] - y) / F.when(dx == 0, F.lit(1e-9)).otherwise(dx)
    slope = F.when(slope == 0, F.lit(1e-20)).otherwise(slope)
    cross = -1 / slope
    side = lambda v: v["y"] - y - cross * (v["x"] - x)
    beyond = F.filter(others, lambda v: (side(v) <= 0) if not both else F.when(side(first) > 0, side(v) <= 0).otherwise(side(v) >= 0))
    left = F.filter(beyond, lambda v: v["y"] - y - slope * (v["x"] - x) > 0)
    right = F.filter(beyond, lambda v: v["y"] - y - slope * (v["x"] - x) <= 0)
    usable = (F.size(left) > 0) & (F.size(right) > 0) & (F.lit(True) if both else side(first) > 0)
    return F.when(usable, _plane([first, F.get(left, F.lit(0)), F.get(right, F.lit(0))], x, y))


def local_planes(points: DataFrame, point_key: str, targets: DataFrame, key: str, x: str = "x", y: str = "y", value: str = "z", k: int = 12, both: bool = False, depth: int | None = None) -> DataFrame:
    """Values at targets from planes through three of the ``k`` nearest points: key, value.

    The nearest point, and the first ones of the others that lie beyond the target on either side of their line, give a
    plane; failing that the second and then the third nearest take its place, and at last the nearest point's value
    stands. Without ``both``, a point below the perpendicular through the target opens no plane, as in charts that
    were made so. Of three points or fewer the mean of the first two stands, of fewer than two nothing. Points without
    a value or a place do not count.
    """
    p = points.filter(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    p = p.select(F.col(point_key).alias("_p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("z"))
    t = targets.select(F.col(key).alias("_t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    few = p.orderBy("_p").limit(4).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("_p", "z"))), 1, 2).alias("two"))
    found = k_nearest(t, "_t", p, "_p", k, depth=depth, carry=["x", "y", "z"])
    lists = found.groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "z"))).alias("near"))
    joined = t.join(lists, "_t", "left").crossJoin(F.broadcast(few))  # a single row
    at = (F.col("x"), F.col("y"))
    planes = [_around(F.col("near"), order, *at, both) for order in ([0], [1, 0], [2, 0, 1])]
    best = F.coalesce(*planes, F.get("near", F.lit(0))["z"])
    pair = (F.get("two", F.lit(0))["z"] + F.get("two", F.lit(1))["z"]) / 2
    value_ = F.when(F.col("n") > 3, best).when(F.col("n") >= 2, pair)
    return joined.select(F.col("_t").alias(key), value_.alias("value"))
