"""Regridding between cells of any convex shape by the areas that they share.

Cells are arrays of corners. Source and target cells meet in the squares that their boxes touch, once a pair; each pair
is clipped, and its area is a weight. The table of weights serves any number of fields on the same two grids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.points import area
from halocline.operators.regrid import cell_bounds2d


def cells_of_mesh(mesh: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """j, i, corners (array<struct<x, y>>, counter-clockwise) of the cells of a mesh of corners (j, i, x, y).

    Cells of which a corner is null or missing are left out, and so are those without area."""
    rows = cell_bounds2d(mesh, (x, y)).groupBy("j", "i").agg(F.count(F.col(x) + F.col(y)).alias("n"), F.array_sort(F.collect_list(F.struct("n", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("c"))
    corners = F.transform("c", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    turned = rows.filter("n = 4").select("j", "i", corners.alias("corners"))
    return turned.withColumn("corners", F.when(signed_area(F.col("corners")) < 0, F.reverse("corners")).otherwise(F.col("corners"))).filter(area(F.col("corners")) > 0)


def signed_area(corners: Column) -> Column:
    """Positive if the corners go counter-clockwise."""
    n = F.size(corners)

    def step(acc: Column, k: Column) -> Column:
        a, b = F.element_at(corners, k), F.element_at(corners, k % n + 1)
        return acc + (a["x"] * b["y"] - b["x"] * a["y"])

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), step) / 2


def clip(subject: Column, window: Column) -> Column:
    """What two convex polygons share, corners counter-clockwise; an empty array if nothing."""
    point = "array<struct<x:double,y:double>>"
    m = F.size(window)

    def half(shape: Column, k: Column) -> Column:
        """The part of ``shape`` to the left of a side of the window."""
        a, b = F.element_at(window, k), F.element_at(window, k % m + 1)
        left = lambda v: (b["x"] - a["x"]) * (v["y"] - a["y"]) - (b["y"] - a["y"]) * (v["x"] - a["x"])
        n = F.size(shape)

        def side(i: Column) -> Column:
            p, q = F.element_at(shape, i), F.element_at(shape, i % n + 1)
            dp, dq = left(p), left(q)
            share = dp / (dp - dq)
            cross = F.struct((p["x"] + share * (q["x"] - p["x"])).alias("x"), (p["y"] + share * (q["y"] - p["y"])).alias("y"))
            return F.when(dp >= 0, F.when(dq >= 0, F.array(p)).otherwise(F.array(p, cross))).when(dq >= 0, F.array(cross)).otherwise(F.array().cast(point)).cast(point)

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), side))).otherwise(F.array().cast(point)).cast(point)

    return F.aggregate(F.sequence(F.lit(1), m), subject.cast(point), half)


def shared_area(a: Column, b: Column) -> Column:
    """Of two convex polygons, corners counter-clockwise."""
    # a list of one, so that the polygon is made once
    return F.element_at(F.transform(F.array(clip(a, b)), lambda p: F.when(F.size(p) > 2, area(p)).otherwise(F.lit(0.0))), 1)


def shared_areas(source: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """Weights sj, si, tj, ti, area of all pairs of cells (j, i, corners) that share an area.

    ``size``: side of the squares in which cells meet, best a little larger than a cell. A pair counts in the square
    that holds the lower left corner of what their boxes share, so it counts once.
    """
    low = lambda c: F.array_min(F.transform("corners", lambda v: v[c]))
    high = lambda c: F.array_max(F.transform("corners", lambda v: v[c]))
    square = lambda c: F.floor(c / size).cast("long")

    def dealt(cells: DataFrame, p: str) -> DataFrame:
        box = cells.select(F.col("j").alias(f"{p}j"), F.col("i").alias(f"{p}i"), F.col("corners").alias(f"{p}_corners"), *[f(c).alias(f"{p}{n}{c}") for c in ("x", "y") for n, f in (("lo", low), ("hi", high))])
        box = box.withColumn("qx", F.explode(F.sequence(square(F.col(f"{p}lox")), square(F.col(f"{p}hix")))))
        return box.withColumn("qy", F.explode(F.sequence(square(F.col(f"{p}loy")), square(F.col(f"{p}hiy")))))

    met = dealt(source, "s").join(dealt(target, "t"), ["qx", "qy"])
    for c in ("x", "y"):
        lo, hi = F.greatest(f"slo{c}", f"tlo{c}"), F.least(f"shi{c}", f"thi{c}")
        met = met.filter((lo < hi) & (F.col(f"q{c}") == square(lo)))
    return met.select("sj", "si", "tj", "ti", shared_area(F.col("s_corners"), F.col("t_corners")).alias("area")).filter("area > 0")


def regrid(field: DataFrame, by: list[str], value: str, weights: DataFrame, target: DataFrame | None = None, method: str = "average") -> DataFrame:
    """A field (by, j, i, value) on the target cells of ``weights``: by, j, i, value.

    ``average``: mean of the valid source cells by shared area. ``conserve``: their sum by share of the target cell, so
    that value x area adds up to what the source holds there; it needs ``target`` (j, i, corners). Cells that no
    valid source cell touches have no row.
    """
    met = field.filter(F.col(value).isNotNull()).join(weights, (F.col("j") == F.col("sj")) & (F.col("i") == F.col("si")))
    sums = met.groupBy(*by, F.col("tj").alias("j"), F.col("ti").alias("i")).agg(F.sum(F.col(value) * F.col("area")).alias("_sum"), F.sum("area").alias("_area"))
    if method == "average":
        return sums.select(*by, "j", "i", (F.col("_sum") / F.col("_area")).alias(value))
    if method != "conserve" or target is None:
        raise ValueError("method is average, or conserve with the target cells")
    whole = target.select("j", "i", area(F.col("corners")).alias("_whole"))
    return sums.join(whole, ["j", "i"]).select(*by, "j", "i", (F.col("_sum") / F.col("_whole")).alias(value))
