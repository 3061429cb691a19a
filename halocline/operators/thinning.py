"""Thinning by a radius: of points that are close only the first in order stays.

The result is that of going through all points in order, keeping each that no kept point has struck and striking all
within its radius. It is reached in rounds. In a tile with a margin around it, a task goes through its undecided points
in order and settles those whose fate hangs on points of the tile alone; the next round lays the tiles otherwise. So a
path of points through space is followed a tile a round. Tiles that hold too many points take one step a round: a point
that comes before all undecided points within the radius stays, whatever else happens, and strikes those. Cells are so
small that any two points of one are close, so only a cell's first undecided point can stay, and a point meets at most
one candidate of each of the cells around.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.cut import Steps

#: Cells of side r / sqrt(2) that may hold points within r of one in the middle cell.
AROUND = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4]


def settle(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
    """By point, in order: 1 stays, 2 struck, 0 not known from these points. Of points that are not ``own`` others may
    be near that are not here: they are struck or not known."""
    fate = np.zeros(len(x), np.int8)
    kept: dict[tuple[int, int], list[int]] = {}
    open_: dict[tuple[int, int], list[int]] = {}
    px, py, cells = x.tolist(), y.tolist(), list(zip(cx.tolist(), cy.tolist(), strict=True))
    for i, (a, b) in enumerate(cells):
        around = [(a + da, b + db) for da, db in AROUND]
        near = lambda k, i=i: math.sqrt((px[k] - px[i]) * (px[k] - px[i]) + (py[k] - py[i]) * (py[k] - py[i])) < radius
        if any(near(k) for c in around for k in kept.get(c, ())):
            fate[i] = 2
        elif not own[i] or any(near(k) for c in around for k in open_.get(c, ())):
            open_.setdefault((a, b), []).append(i)
        else:
            fate[i] = 1
            kept.setdefault((a, b), []).append(i)
    return fate


def thin_by_radius(points: DataFrame, key: str, radius: float, x: str = "x", y: str = "y", value: str | None = None, mean: float = 0.7, tile: int = 64, most: int = 5000) -> DataFrame:
    """The points that stay: key, x, y and, if given, value: the mean of the values within ``mean`` x ``radius``.

    Points go in order of ``key``, which no two share; one strikes those nearer than ``radius``, in the plane. The mean
    is over all points, struck ones too, nearer than ``mean`` (0 to 1) of the radius; a null value does not count, and
    with 0 the point keeps its own. Points without a position are left out. A task holds up to ``most`` points of a tile of
    ``tile`` cells each way. There are as many rounds as points hang on each other over tiles.
    """
    side = radius / math.sqrt(2)
    cell = [F.floor(F.col(c) / side).cast("long").alias(a) for c, a in (("x", "cx"), ("y", "cy"))]
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(key).isNotNull())
    p = p.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *([F.col(value).cast("double").alias("value")] if value else []))
    steps = Steps(points.sparkSession, "thinning")
    p = steps.write(p.select("*", *cell))
    # of points at one place the first alone can stay
    open_ = steps.write(p.groupBy("x", "y", "cx", "cy").agg(F.min("key").alias("key")))
    kept, turn, kind = None, 0, points.schema[key].dataType.simpleString()

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        fate = settle(*(part[c].to_numpy() for c in ("x", "y", "cx", "cy", "own")), radius)
        known = part["own"].to_numpy() & (fate > 0)
        return part[["key", "x", "y", "cx", "cy"]].assign(fate=fate)[known]

    while True:
        shift = turn * tile // 2
        at = [F.floor((F.col(c) + shift) / tile).cast("long") for c in ("cx", "cy")]
        beside = [F.array_distinct(F.array(*[F.floor((F.col(c) + shift + k) / tile).cast("long") for k in (-2, 0, 2)])) for c in ("cx", "cy")]
        laid = open_.withColumn("tx", F.explode(beside[0])).withColumn("ty", F.explode(beside[1])).withColumn("own", (F.col("tx") == at[0]) & (F.col("ty") == at[1]))
        sizes = steps.write(laid.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n")))
        full = sizes.filter(F.col("n") > most)
        crowded = not full.isEmpty()
        light = laid.join(full.select("tx", "ty"), ["tx", "ty"], "left_anti") if crowded else laid
        told = steps.write(light.groupBy("tx", "ty").applyInPandas(resolve, f"key {kind}, x double, y double, cx long, cy long, fate tinyint"))
        stay = told.filter("fate = 1").select("cx", "cy", F.col("key").alias("fkey"), F.col("x").alias("fx"), F.col("y").alias("fy"))
        if crowded:
            first = open_.groupBy("cx", "cy").agg(F.min(F.struct("key", "x", "y")).alias("f"))
            candidates = steps.write(first.select("cx", "cy", F.col("f.key").alias("fkey"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy")))
            met = open_.join(_spread(candidates), ["cx", "cy"]).filter(_near(radius) & (F.col("key") < F.col("fkey")))
            step = candidates.join(met.select("fkey").distinct(), "fkey", "left_anti")
            stay = stay.unionByName(step).dropDuplicates(["fkey"])
        stay = steps.write(stay)
        found = stay.select(F.col("fkey").alias("key"), F.col("fx").alias("x"), F.col("fy").alias("y"))
        kept = found if kept is None else kept.unionByName(found)
        struck = open_.join(_spread(stay), ["cx", "cy"]).filter(_near(radius)).select("key").distinct()
        open_ = steps.write(open_.join(struck, "key", "left_anti"))
        turn = 1 - turn
        if open_.isEmpty():
            break
    if not value:
        return kept.select(F.col("key").alias(key), F.col("x").alias(x), F.col("y").alias(y))
    if mean <= 0:
        return kept.join(p.select("key", "value"), "key").select(F.col("key").alias(key), F.col("x").alias(x), F.col("y").alias(y), F.col("value").alias(value))
    centres = kept.select("key", F.col("key").alias("fkey"), F.col("x").alias("fx"), F.col("y").alias("fy"), *[F.floor(F.col(c) / side).cast("long").alias(a) for c, a in (("x", "cx"), ("y", "cy"))]).drop("key")
    means = p.join(_spread(centres), ["cx", "cy"]).filter(_near(radius * min(mean, 1.0))).groupBy("fkey", "fx", "fy").agg(F.avg("value").alias("value"))
    return means.select(F.col("fkey").alias(key), F.col("fx").alias(x), F.col("fy").alias(y), F.col("value").alias(value))


def _spread(candidates: DataFrame) -> DataFrame:
    """Each candidate in all cells that may hold a point within the radius."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]))
    return candidates.withColumn("s", around).select((F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"), "fkey", "fx", "fy")


def _near(radius: float) -> Column:
    dx, dy = F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    return F.sqrt(dx * dx + dy * dy) < radius
