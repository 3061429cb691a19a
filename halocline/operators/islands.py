"""Connected cells of a grid: lakes, oceans, and what is left of a mask without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.cut import Steps


def label(field: DataFrame, by: list[str], water: Column) -> DataFrame:
    """by, j, i, lake_j, lake_i, cells of all water cells: the first cell, by j then i, of those that sides connect to
    it, and how many they are.

    Every cell points to the smallest cell it knows; in each round it takes the smallest of its neighbours', and then
    that one's own: distances double, so rounds grow with the logarithm of a lake's length.
    """
    steps = Steps(field.sparkSession, "islands")
    cells = field.filter(water).select(*by, "j", "i", F.struct("j", "i").alias("to"))
    cells = steps.write(cells)
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    while True:
        told = cells.withColumn("s", F.explode(sides)).select(*by, (F.col("j") + F.col("s.a")).alias("j"), (F.col("i") + F.col("s.b")).alias("i"), "to")
        least = told.groupBy(*by, "j", "i").agg(F.min("to").alias("least"))
        near = cells.join(least, [*by, "j", "i"])
        jump = cells.select(*by, F.col("j").alias("_j"), F.col("i").alias("_i"), F.col("to").alias("then"))
        same = (F.col("least.j") == F.col("_j")) & (F.col("least.i") == F.col("_i"))
        for c in by:
            same = same & near[c].eqNullSafe(jump[c])
        moved = near.join(jump, same).select(*[near[c] for c in by], "j", "i", F.least("least", "then").alias("new"), "to")
        moved = steps.write(moved)
        changed = moved.filter("new != to").isEmpty()
        cells = moved.select(*by, "j", "i", F.col("new").alias("to"))
        if changed:
            break
    size = cells.groupBy(*by, "to").agg(F.count(F.lit(1)).alias("cells"))
    return cells.join(size, [*by, "to"]).select(*by, "j", "i", F.col("to.j").alias("lake_j"), F.col("to.i").alias("lake_i"), "cells")


def ocean(labels: DataFrame, by: list[str]) -> DataFrame:
    """Cells of the largest lake; of equal ones the first."""
    lakes = labels.groupBy(*by, "lake_j", "lake_i").agg(F.first("cells").alias("n"))
    best = lakes.groupBy(*by).agg(F.min_by(F.struct("lake_j", "lake_i"), F.struct(-F.col("n"), F.col("lake_j"), F.col("lake_i"))).alias("b")) if by else lakes.agg(F.min_by(F.struct("lake_j", "lake_i"), F.struct(-F.col("n"), F.col("lake_j"), F.col("lake_i"))).alias("b"))
    return labels.join(best.select(*by, "b.lake_j", "b.lake_i"), [*by, "lake_j", "lake_i"], "left_semi")
