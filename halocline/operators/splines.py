"""Cubic splines along one axis, a series a task, and extrema refined on a cubic.

The spline passes all valid nodes; its third derivative does not jump at the second and the last but one, so that a
cubic is met exactly. Of three nodes it is the parabola, of two the line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def through(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline through (x, y), x ascending, at positions ``at``; NaN outside the nodes."""
    out = np.full(len(at), np.nan)
    n = len(x)
    inside = (at >= x[0]) & (at <= x[-1]) if n else np.zeros(len(at), bool)
    if n == 1:
        out[inside] = y[0]
    elif n == 2:
        out[inside] = np.interp(at[inside], x, y)
    elif n > 2:
        h, slope = np.diff(x), np.diff(y) / np.diff(x)
        if n == 3:
            m = np.full(3, 2 * (slope[1] - slope[0]) / (x[2] - x[0]))
        else:
            m = np.zeros(n)
            # unknown second derivatives of the inner nodes; those of the ends follow from their neighbours
            low, mid, high, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
            a, b = h[0] / h[1], h[-1] / h[-2]
            mid[0] += h[0] * (1 + a)
            high[0] -= h[0] * a
            mid[-1] += h[-1] * (1 + b)
            low[-1] -= h[-1] * b
            for k in range(1, n - 2):
                w = low[k] / mid[k - 1]
                mid[k] -= w * high[k - 1]
                right[k] -= w * right[k - 1]
            m[n - 2] = right[-1] / mid[-1]
            for k in range(n - 4, -1, -1):
                m[k + 1] = (right[k] - high[k] * m[k + 2]) / mid[k]
            m[0], m[-1] = (1 + a) * m[1] - a * m[2], (1 + b) * m[-2] - b * m[-3]
        k = np.clip(np.searchsorted(x, at[inside], side="right") - 1, 0, n - 2)
        t, u = at[inside] - x[k], x[k + 1] - at[inside]
        out[inside] = (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t
    return out


def spline(src: DataFrame, dst: DataFrame, by: list[str], x: str, value: str, out: str = "value") -> DataFrame:
    """Values of ``src`` at the positions of ``dst`` (by, x): by, x, ``out``; null outside the valid nodes. Nodes at one
    place count as their mean. The series of one ``by`` is solved in one task."""
    keys = [f"{b}" for b in by]
    schema = ", ".join([*[f"`{b}` {dst.schema[b].dataType.simpleString()}" for b in keys], f"`{x}` double", f"`{out}` double"])

    def solve(key: tuple, nodes: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.dropna(subset=[x, value]).groupby(x, as_index=False)[value].mean().sort_values(x)
        found = through(nodes[x].to_numpy(float), nodes[value].to_numpy(float), places[x].to_numpy(float))
        return pd.DataFrame({**{b: places[b] for b in keys}, x: places[x], out: found})

    own = [F.col(k).alias(k) for k in by]  # new columns, as both tables may come from one
    a = src.select(*own, F.col(x).cast("double").alias(x), F.col(value).cast("double").alias(value))
    b = dst.filter(F.col(x).isNotNull()).select(*own, F.col(x).cast("double").alias(x))
    done = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(solve, schema)
    return done.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def fill_spline(df: DataFrame, by: list[str], position: str, value: str, out: str = "filled") -> DataFrame:
    """Nulls between valid cells, on the spline of these: by, position, ``out``. Positions of a ``by`` differ."""
    keys = [*by, position]
    found = spline(df, df.filter(F.col(value).isNull()), by, position, value, "_found").toDF(*[f"_{k}" for k in keys], "_found")
    rows = df.withColumn(position, F.col(position).cast("double"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(found, match, "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumn(out, F.coalesce(F.col(value).cast("double"), F.col("_found"))).drop("_found")


def refined_extrema(df: DataFrame, by: list[str], ts: str, anomaly: str) -> DataFrame:
    """High (sign 1) and low (-1) water to the minute: of each run of one sign its extremum on the cubic through four of
    its cells around it, by centred slopes, the ends' outer neighbours on the line of the last two. Runs of less than
    four cells give the cell itself. An extremum at the edge of its run, and the runs at either end, give none."""
    w = W.partitionBy(*by).orderBy("_t")
    sign = F.when(F.col(anomaly) >= 0, 1).otherwise(-1)
    rows = df.filter(F.col(anomaly).isNotNull()).select(*by, F.col(ts).alias("_t"), F.col(anomaly).cast("double").alias("_v"), sign.alias("sign"))
    rows = rows.withColumn("_new", F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*by, "_run").orderBy("_t")
    cell = F.struct("_t", "_v")
    near = {f"_{k + 2}": (F.lag(cell, -k) if k < 0 else F.lead(cell, k) if k else cell) for k in range(-2, 3)}
    rows = rows.withColumns({c: v.over(run) if c != "_2" else v for c, v in near.items()})
    best = rows.groupBy(*by, "_run", "sign").agg(
        F.max_by(F.struct(*[F.col(f"_{k}").alias(f"c{k}") for k in range(5)]), F.struct(F.col("_v") * F.col("sign"), F.col("_t"))).alias("b"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    at = lambda k: F.col(f"b.c{k + 2}")
    inner = best.filter((at(0)["_t"] > F.col("_lo")) & (at(0)["_t"] < F.col("_hi")))
    # four cells from the one before the higher neighbour, moved into the run
    back = at(-1)["_v"] > at(1)["_v"]
    early, late = F.array(at(-2), at(-1), at(0), at(1)), F.array(at(-1), at(0), at(1), at(2))
    four = F.when((back & at(-2).isNotNull()) | at(2).isNull(), early).otherwise(late)
    minutes = F.timestamp_diff("MINUTE", F.col("four")[0]["_t"], F.col("four")[3]["_t"])
    rows = inner.withColumn("four", F.when(F.col("_n") >= 4, four))
    place = lambda k: F.timestamp_diff("SECOND", F.col("four")[0]["_t"], F.col("four")[k]["_t"]) / 60.0

    def cubic(m: Column) -> Column:
        out = None
        for k in range(3):
            y0, y1, x0, x1 = F.col("four")[k]["_v"], F.col("four")[k + 1]["_v"], place(k), place(k + 1)
            before = F.col("four")[k - 1]["_v"] if k else 2 * y0 - y1
            after = F.col("four")[k + 2]["_v"] if k < 2 else 2 * y1 - y0
            p = (m - x0) / (x1 - x0)
            m0, m1 = (y1 - before) / 2, (after - y0) / 2
            value = (2 * p * p * p - 3 * p * p + 1) * y0 + (p * p * p - 2 * p * p + p) * m0 + (3 * p * p - 2 * p * p * p) * y1 + (p * p * p - p * p) * m1
            out = F.when(m <= x1, value) if out is None else out.when(m <= x1, value)
        return out

    grid = F.transform(F.sequence(F.lit(0).cast("long"), minutes), lambda m: F.struct((cubic(m.cast("double")) * F.col("sign")).alias("h"), (-m).alias("m")))
    top = rows.withColumn("top", F.array_max(grid))
    found_t = F.coalesce(F.timestamp_add("MINUTE", -F.col("top.m"), F.col("four")[0]["_t"]), at(0)["_t"])
    return top.select(*by, found_t.alias(ts), F.coalesce(F.col("top.h") * F.col("sign"), at(0)["_v"]).alias("value"), "sign")
