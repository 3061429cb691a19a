"""Scattered data: variogram and kriging, cloud by cloud.

``krige_clouds`` halves the points until no cloud is too large for a linear system; a cloud's system is solved once for
all targets near it, and a target blends the estimates of several clouds by their errors. ``krige`` takes a square and
the eight around it instead; where that is too much, targets go on with squares half as wide, and take the nearer points
only. Either way every task solves systems of bounded size. Points at one place count as their mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.operators.cut import Steps
from halocline.operators.neighbours import k_nearest
from halocline.operators.stats import quantiles


def variogram(df: DataFrame, key: str, width: float, longest: float, x: str = "x", y: str = "y", value: str = "z") -> DataFrame:
    """Half mean squared differences of all pairs up to ``longest`` apart, by distance: bin, distance, gamma, pairs.

    Bins of equal width; ``equal_count_bins`` has bins of equally many pairs.
    """
    return _mean_pairs(_pairs(df, longest, x, y, value), F.floor(F.col("d") / width).cast("int").alias("bin"))


def _mean_pairs(pairs: DataFrame, bin_: Column) -> DataFrame:
    n = F.sum("n")
    return pairs.groupBy(bin_).agg((F.sum(F.col("d") * F.col("n")) / n).alias("distance"), (F.sum("g") / n).alias("gamma"), n.alias("pairs"))


def _pairs(df: DataFrame, longest: float, x: str, y: str, value: str) -> DataFrame:
    """d, n, g: of all pairs nearer than ``longest`` distances, how many pairs, and the sum of their half squared differences.

    Points at one place count together, by their number, mean and squared deviations, which tell the squared differences
    to those of another place, and among each other. Places meet in coarse cells as wide as ``longest``: each goes to its
    own cell, and to the neighbours on one side to meet theirs, so no pair is made twice and none that is farther.
    """
    p = df.filter(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    p = p.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    z = F.col(value).cast("double")
    p = Steps(df.sparkSession, "variogram").write(p.agg(F.count(F.lit(1)).alias("n"), F.avg(z).alias("m"), (F.var_pop(z) * F.count(F.lit(1))).alias("q")))
    cx, cy = F.floor(F.col("x") / longest), F.floor(F.col("y") / longest)
    own = p.select(*[F.col(c).alias(f"{c}1") for c in p.columns], cx.alias("cx"), cy.alias("cy"))
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1), (-1, 1))])
    other = p.withColumn("s", F.explode(sides)).select(*[F.col(c).alias(f"{c}2") for c in p.columns], (cx - F.col("s.a")).alias("cx"), (cy - F.col("s.b")).alias("cy"), (F.col("s.a") == 0).alias("ha"), (F.col("s.b") == 0).alias("hb"))
    first = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    pairs = own.join(other, ["cx", "cy"]).filter((~(F.col("ha") & F.col("hb"))) | first)
    d = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    apart = F.col("m2") - F.col("m1")
    g = (F.col("n1") * F.col("n2") * apart * apart + F.col("n1") * F.col("q2") + F.col("n2") * F.col("q1")) / 2
    between = pairs.select(d.alias("d"), (F.col("n1") * F.col("n2")).alias("n"), g.alias("g")).filter(F.col("d") < longest)
    within = p.filter("n > 1").select(F.lit(0.0).alias("d"), F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"), (F.col("n") * F.col("q") / 2).alias("g"))
    return between.unionByName(within)


def model(kind: str, h, nugget: float, sill: float, reach: float):
    """Variogram value at the distance h, a numpy array: linear, exponential, spherical or gaussian."""
    r = np.asarray(h, float) / reach
    shapes = {"linear": lambda: np.minimum(r, 1), "exponential": lambda: 1 - np.exp(-3 * r), "spherical": lambda: np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0), "gaussian": lambda: 1 - np.exp(-3 * r * r)}
    return np.where(r > 0, nugget + (sill - nugget) * shapes[kind](), 0.0)


def model_column(kind: str, h: Column, nugget: float, sill: float, reach: float) -> Column:
    """As ``model``, of a column."""
    r = h / reach
    shape = {"linear": F.least(r, F.lit(1.0)), "exponential": 1 - F.exp(-3 * r), "spherical": F.when(r < 1, 1.5 * r - 0.5 * r * r * r).otherwise(1.0), "gaussian": 1 - F.exp(-3 * r * r)}[kind]
    return F.when(r > 0, nugget + (sill - nugget) * shape).otherwise(0.0)


def equal_count_bins(df: DataFrame, key: str, longest: float, bins: int = 30, x: str = "x", y: str = "y", value: str = "z", accuracy: int | None = None) -> DataFrame:
    """A variogram whose bins hold equally many pairs of up to ``longest`` apart: bin, distance, gamma, pairs.

    The edges are quantiles of the distances, exact ones, found in ``accuracy`` slices of them (a hundredth of a bin
    unless given, 65,536 at most), so that pairs are never sorted as a whole; pairs at one distance are in one bin.
    """
    steps = Steps(df.sparkSession, "equal_counts")
    p = steps.write(_pairs(df, longest, x, y, value).groupBy("d").agg(F.sum("n").alias("n"), F.sum("g").alias("g")))
    edges = quantiles(p, "d", "n", [k / bins for k in range(1, bins)], min(accuracy or 100 * bins, 65_536), steps).agg(F.array_sort(F.collect_list("value")).alias("_edges"))
    bin_ = F.size(F.filter("_edges", lambda e: e < F.col("d")))
    return _mean_pairs(p.crossJoin(F.broadcast(edges)), bin_.alias("bin"))  # a single row


def fit_variogram(binned: pd.DataFrame, kind: str = "exponential", most_nugget: float = 0.2) -> tuple[float, float, float]:
    """nugget, sill and range of least squares, weighted by pairs, on a grid of ranges and nuggets; ``binned`` has a
    row a bin."""
    d, g, w = (binned[c].to_numpy(float) for c in ("distance", "gamma", "pairs"))
    best = None
    for reach in np.linspace(d.max() / 40, d.max(), 80):
        for share in np.linspace(0, most_nugget, 9):
            shape = model(kind, d, share, 1.0, reach)
            sill = (w * g * shape).sum() / max((w * shape * shape).sum(), 1e-12)
            miss = (w * (g - sill * shape) ** 2).sum()
            if best is None or miss < best[0]:
                best = (miss, share * sill, sill, reach)
    return best[1:]


def fit_several(binned: DataFrame, by: list[str], kind: str = "exponential", most_nugget: float = 0.2) -> DataFrame:
    """Medians of the parameters fitted to several variograms (by, distance, gamma, pairs): nugget, sill, reach. Each
    variogram, a row a bin, is fitted in a task."""
    def fit(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fit_variogram(part, kind, most_nugget)], columns=["nugget", "sill", "reach"])

    fitted = binned.groupBy(*by).applyInPandas(fit, "nugget double, sill double, reach double")
    return fitted.agg(*[F.median(c).alias(c) for c in ("nugget", "sill", "reach")])


def krige(points: DataFrame, targets: DataFrame, key: str, size: float, kind: str, nugget: float, sill: float, reach: float, most: int = 1000, x: str = "x", y: str = "y", value: str = "z",
          mean: float | None = None) -> DataFrame:
    """Kriging of ``points`` at ``targets`` (key, x, y): key, value, error. Ordinary, or simple about a known ``mean``.

    A target is estimated from the points of its own square of side ``size`` and of the eight around it, if these are
    ``most`` or fewer; if not, from squares half as wide, until they are. Points at one place count as their mean, so
    that halving ends. Targets without points near are null. Every level is written.
    """
    p = points.filter(F.col(value).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.avg(value).alias("z"))
    steps = Steps(points.sparkSession, "krige")
    p = steps.write(p)
    rest = steps.write(targets.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    square = lambda c, s: F.floor(F.col(c) / s).cast("long")
    side, out, key_type = size, None, targets.schema[key].dataType.simpleString()
    schema = f"key {key_type}, value double, error double"

    def solve(cell: tuple, mine: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(there):
            return pd.DataFrame({"key": [], "value": [], "error": []})
        if not len(mine):
            return pd.DataFrame({"key": there["key"], "value": np.nan, "error": np.nan})
        a, at, z = mine[["x", "y"]].to_numpy(), there[["x", "y"]].to_numpy(), mine["z"].to_numpy()
        value_, variance = estimates(a, z, np.zeros(len(a)), at, kind, nugget, sill, reach, mean)
        return pd.DataFrame({"key": there["key"], "value": value_, "error": np.sqrt(variance)})

    while True:
        cells = p.groupBy(square("x", side).alias("cx"), square("y", side).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
        near = cells.withColumn("s", F.explode(around)).groupBy((F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy")).agg(F.sum("n").alias("n"))
        crowded = steps.write(near.filter(F.col("n") > most).select("cx", "cy"))
        placed = rest.withColumns({"cx": square("x", side), "cy": square("y", side)})
        now = steps.write(placed.join(crowded, ["cx", "cy"], "left_anti"))
        spread = p.withColumn("s", F.explode(around)).select("x", "y", "z", (square("x", side) + F.col("s.a")).alias("cx"), (square("y", side) + F.col("s.b")).alias("cy"))
        spread = spread.join(now.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")  # no square without a target is gathered
        solved = steps.write(spread.groupBy("cx", "cy").cogroup(now.groupBy("cx", "cy")).applyInPandas(solve, schema))
        out = solved if out is None else out.unionByName(solved)
        rest = steps.write(placed.join(crowded, ["cx", "cy"], "left_semi").select("key", "x", "y"))
        if rest.isEmpty():
            break
        side /= 2
    nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select(F.col("key").alias(key), nan("value"), nan("error"))


TURN = 0.7  # the axes that clouds are halved on are turned by so much, so that points of a grid do not share a coordinate


def split_clouds(points: DataFrame, most: int, steps: Steps) -> DataFrame:
    """``points`` (x, y, no two at one place) with ``cloud``, of ``most`` points or fewer.

    Clouds that are too large are halved at the median of their longer axis, all in one round; medians are quantiles of
    bounded error, so halves differ by a few points.
    """
    c, s = float(np.cos(TURN)), float(np.sin(TURN))
    rows = steps.write(points.withColumns({"_u": F.col("x") * c + F.col("y") * s, "_v": F.col("y") * c - F.col("x") * s, "cloud": F.lit(0).cast("long")}))
    depth = 0
    while True:
        sizes = rows.groupBy("cloud").agg(F.count(F.lit(1)).alias("_n"), (F.max("_u") - F.min("_u") >= F.max("_v") - F.min("_v")).alias("_long"), F.percentile_approx("_u", 0.5, 10_000).alias("_mu"), F.percentile_approx("_v", 0.5, 10_000).alias("_mv"))
        large = steps.write(sizes.filter(F.col("_n") > most))
        if large.isEmpty():
            return rows.drop("_u", "_v")
        # 2 to the power of the round is how many there are at most
        joined = rows.join(F.broadcast(large) if depth < 16 else large, "cloud", "left")
        upper = F.when(F.col("_long"), F.col("_u") > F.col("_mu")).otherwise(F.col("_v") > F.col("_mv"))
        rows = steps.write(joined.withColumn("cloud", F.col("cloud") * 2 + F.coalesce(upper.cast("long"), F.lit(0))).select(rows.columns))
        depth += 1


def estimates(a: np.ndarray, z: np.ndarray, e: np.ndarray, at: np.ndarray, kind: str, nugget: float, sill: float, reach: float, mean: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Values and variances at ``at`` from points ``a`` of values ``z`` and errors ``e``: ordinary, or simple about ``mean``."""
    apart = lambda p, q: np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
    between, to = model(kind, apart(a, a), nugget, sill, reach), model(kind, apart(a, at), nugget, sill, reach)
    n = len(a)
    if mean is not None:  # covariances, which fall from the sill
        weights = np.linalg.solve(sill - between + np.diag(e * e), sill - to)
        return mean + weights.T @ (z - mean), np.maximum(sill - (weights * (sill - to)).sum(0), 0)
    system, right = np.ones((n + 1, n + 1)), np.ones((n + 1, len(at)))
    system[:n, :n], right[:n], system[n, n] = between - np.diag(e * e), to, 0
    weights = np.linalg.solve(system, right)
    return weights[:n].T @ z, np.maximum((weights * right).sum(0), 0)


def krige_clouds(points: DataFrame, targets: DataFrame, key: str, kind: str, nugget: float, sill: float, reach: float, most: int = 1000, clouds: int = 4, x: str = "x", y: str = "y", value: str = "z",
                 error: str | None = None, mean: float | None = None, at_once: int = 500) -> DataFrame:
    """Kriging of ``points`` at ``targets`` (key, x, y) from clouds of ``most`` points: key, value, error.

    Ordinary, or simple about a known ``mean``, which is also the value far from all points. ``error``: a column of the
    points' errors of observation, null as none: they add to the variance of a point with itself. A target takes its
    ``clouds`` nearest clouds by their centres; their values are weighted by 1 / variance^2, and the variances of the
    result add up as such weights. Points at one place count as their mean, and so do their errors. Without any points
    targets are null, and so are those without a position. Targets at one place ask once; a system is solved for
    ``at_once`` of them.
    """
    steps = Steps(points.sparkSession, "krige")
    e = F.coalesce(F.col(error).cast("double"), F.lit(0.0)) if error else F.lit(0.0)
    p = points.filter(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    p = p.groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.avg(value).alias("z"), F.avg(e).alias("e"))
    p = split_clouds(p, most, steps)
    t = steps.write(targets.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    centres = steps.write(p.groupBy("cloud").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))
    places = steps.write(t.filter("x is not null and y is not null").select("x", "y").distinct().withColumn("key", F.struct("x", "y")))
    near = k_nearest(places, "key", centres, "cloud", clouds).select("key", "cloud")
    near = steps.write(near.select("cloud", F.xxhash64("key").alias("hash"), "key.x", "key.y"))
    parts = near.groupBy("cloud").agg(F.ceil(F.count(F.lit(1)) / (4 * at_once)).cast("int").alias("parts"))
    asked = near.join(parts, "cloud").withColumn("part", F.pmod("hash", F.col("parts")).cast("int")).drop("parts", "hash")
    sent = p.join(parts, "cloud").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def solve(_: tuple, mine: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(there):
            return pd.DataFrame({"x": [], "y": [], "value": [], "weight": []})
        a, at = mine[["x", "y"]].to_numpy(), there[["x", "y"]].to_numpy()
        found = [estimates(a, mine["z"].to_numpy(), mine["e"].to_numpy(), at[i : i + at_once], kind, nugget, sill, reach, mean) for i in range(0, len(at), at_once)]
        value_, variance = (np.concatenate(v) for v in zip(*found, strict=True))
        return pd.DataFrame({"x": there["x"], "y": there["y"], "value": value_, "weight": 1 / np.maximum(variance, 1e-9 * sill) ** 2})

    solved = sent.groupBy("cloud", "part").cogroup(asked.groupBy("cloud", "part")).applyInPandas(solve, "x double, y double, value double, weight double")
    blended = solved.groupBy("x", "y").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"), F.pow(F.sum("weight"), F.lit(-0.25)).alias("error"))
    return t.join(blended, ["x", "y"], "left").select(F.col("key").alias(key), "value", "error")


def three_gaussians(x: Column, y: Column) -> Column:
    """A smooth test surface: two hills and a hollow."""
    bump = lambda x0, y0, dx, dy, f: f * F.exp(-(F.pow((x - x0) / dx, F.lit(2.0)) + F.pow((y - y0) / dy, F.lit(2.0))))
    return bump(-1, 0.5, 1, 1, 1.0) + bump(1, 1, 2, 0.5, -1.0) + bump(0, -1.5, 0.5, 0.5, 0.8)
