"""Fields from one grid to another, and the geometry of grids: corners, cells, envelopes, orientation.

On rectangular grids the weight of a source cell in a target cell is a product of one weight along each axis. An axis
is small (a row a column of the grid), so its weights are a small table; the field meets both in two equi-joins and one
aggregation, whatever the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.operators.grid import extend
from halocline.operators.points import inside


def axis(values: DataFrame, index: str = "k", x: str = "x") -> DataFrame:
    """k, x, lo, hi of an axis given by its centres: cells reach half way to their neighbours, as far beyond the ends."""
    w = W.orderBy(index)
    at, before, after = F.col(x), F.lag(x).over(w), F.lead(x).over(w)
    lo = F.when(before.isNull(), at - (after - at) / 2).otherwise((before + at) / 2)
    hi = F.when(after.isNull(), at + (at - before) / 2).otherwise((at + after) / 2)
    return values.select(F.col(index).cast("int").alias("k"), at.cast("double").alias("x"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))


def axis_weights(src: DataFrame, dst: DataFrame, method: str) -> DataFrame:
    """k (of ``src``), t (of ``dst``), w: the weights of source cells along one axis. Axes as from ``axis``.

    ``average``: lengths of overlap; ``conserve``: overlap by length of the source cell; ``linear``: both neighbours of
    the target's centre; ``nearest``: the nearer one, of two equally far the upper. Targets outside have none.
    """
    t = dst.select(F.col("k").alias("t"), F.col("x").alias("tx"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    if method in ("average", "conserve"):
        width = F.least("hi", "thi") - F.greatest("lo", "tlo")
        pairs = src.join(F.broadcast(t), (F.col("lo") < F.col("thi")) & (F.col("hi") > F.col("tlo")))  # axes of grids
        return pairs.select("k", "t", (width / (F.col("hi") - F.col("lo")) if method == "conserve" else width).alias("w"))
    # sources and targets in one order: the last source at or before a target, and the first at or after it
    rows = src.select("x", F.struct("x", "k").alias("s"), F.lit(None).cast("int").alias("t")).unionByName(t.select(F.col("tx").alias("x"), F.lit(None).cast("struct<x:double,k:int>").alias("s"), "t"))
    down = W.orderBy("x", F.col("s").isNull()).rowsBetween(W.unboundedPreceding, 0)
    up = W.orderBy(F.col("x").desc(), F.col("s").isNull()).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumns({"a": F.last("s", ignorenulls=True).over(down), "b": F.last("s", ignorenulls=True).over(up)}).filter("t is not null and a is not null and b is not null")
    p = F.when(F.col("a.k") == F.col("b.k"), 0.0).otherwise((F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x")))
    if method == "nearest":
        return found.select(F.when(p < 0.5, F.col("a.k")).otherwise(F.col("b.k")).alias("k"), "t", F.lit(1.0).alias("w"))
    both = F.array(F.struct(F.col("a.k").alias("k"), (1 - p).alias("w")), F.struct(F.col("b.k").alias("k"), p.alias("w")))
    return found.select("t", F.explode(both).alias("c")).select("c.k", "t", "c.w").filter("w > 0")


def regrid2d(field: DataFrame, by: list[str], value: str, x: tuple[DataFrame, DataFrame], y: tuple[DataFrame, DataFrame], method: str = "average", out: str = "value") -> DataFrame:
    """A field (by, j, i, value) on another rectangular grid: by, j, i, ``out``. x and y: source and target axis.

    ``average``: means by area of overlap of the valid cells; ``conserve``: sums of what falls into the target;
    ``bilinear``: null where a corner that has weight is null; ``nearest``. Target cells that no source cell has weight
    in are left out. An axis is a few thousand rows: the tables of weights are broadcast if the planner finds them small.
    """
    along = {"bilinear": "linear"}.get(method, method)
    wx = axis_weights(*x, along).select(F.col("k").alias("i"), F.col("t").alias("ti"), F.col("w").alias("wx"))
    wy = axis_weights(*y, along).select(F.col("k").alias("j"), F.col("t").alias("tj"), F.col("w").alias("wy"))
    joined = field.select(*by, "j", "i", F.col(value).cast("double").alias("_v")).join(wx, "i").join(wy, "j").withColumn("_w", F.col("wx") * F.col("wy"))
    v, w = F.col("_v"), F.col("_w")
    if method == "average":
        result = F.sum(v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))
    elif method == "conserve":
        result = F.sum(v * w)
    elif method == "bilinear":  # the weights of all corners sum to 1
        result = F.when(F.abs(F.sum(F.when(v.isNotNull(), w)) - 1) < 1e-9, F.sum(v * w))
    else:
        result = F.max(v)
    return joined.groupBy(*by, F.col("tj").alias("j"), F.col("ti").alias("i")).agg(result.alias(out))


def best_method(step_in: float, step_out: float) -> str:
    """``average`` if the source is finer than about half the target, else ``bilinear``."""
    return "average" if step_in <= 0.55 * step_out else "bilinear"


def _edges(index: str, n: int) -> Column:
    """array<struct<c, w>>: the corners along one axis that a centre takes part in. Beyond the ends lie as much as within."""
    k = F.col(index)
    at = lambda c, w: F.struct(c.cast("int").alias("c"), F.lit(float(w)).alias("w"))
    none = F.lit(None).cast("struct<c:int,w:double>")
    low = F.when(k == 0, at(k, 1.5)).otherwise(at(k, 0.5))
    high = F.when(k == n - 1, at(k + 1, 1.5)).otherwise(at(k + 1, 0.5))
    before = F.when(k == 1, at(F.lit(0), -0.5)).otherwise(none)
    after = F.when(k == n - 2, at(F.lit(n), -0.5)).otherwise(none)
    return F.filter(F.array(low, high, before, after), lambda c: c.isNotNull())


def corners(grid: DataFrame, nj: int, ni: int, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Corners of the cells of a grid of centres (j, i, values), nj x ni of them, two or more each way: a row for
    j 0 .. nj and i 0 .. ni. Inside means of four centres; at the edge continued by half a step, at the four outermost
    corners along the diagonal."""
    both = F.flatten(F.transform(_edges("j", nj), lambda a: F.transform(_edges("i", ni), lambda b: F.struct(a["c"].alias("j"), b["c"].alias("i"), (a["w"] * b["w"]).alias("w")))))
    outermost = (F.col("p.j").isin(0, nj)) & (F.col("p.i").isin(0, ni))
    spread = grid.select(*values, F.explode(both).alias("p")).filter(~outermost).select("p.j", "p.i", *[(F.col(v) * F.col("p.w")).alias(v) for v in values])
    ends = []
    for cj, j, dj in ((0, 0, 1), (nj, nj - 1, -1)):
        for ci, i, di in ((0, 0, 1), (ni, ni - 1, -1)):
            w = F.when((F.col("j") == j) & (F.col("i") == i), 1.5).when((F.col("j") == j + dj) & (F.col("i") == i + di), -0.5)
            ends.append(F.struct(F.lit(cj).alias("j"), F.lit(ci).alias("i"), w.cast("double").alias("w")))
    diagonal = grid.select(*values, F.explode(F.array(*ends)).alias("p")).filter("p.w is not null").select("p.j", "p.i", *[(F.col(v) * F.col("p.w")).alias(v) for v in values])
    return spread.unionByName(diagonal).groupBy("j", "i").agg(*[F.sum(v).alias(v) for v in values])


def cell_bounds2d(mesh: DataFrame, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """j, i, n and the values of each cell's corners n: 0 lower left, 1 lower right, 2 upper right, 3 upper left. From
    ``corners``; the corners come out of it again as those with n = 0, and at the far edges 1, 3 and 2."""
    places = F.array(*[F.struct(F.lit(n).alias("n"), (F.col("j") - b).alias("j"), (F.col("i") - a).alias("i")) for n, (b, a) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])
    spread = mesh.select(*values, F.explode(places).alias("p")).select("p.j", "p.i", "p.n", *values)
    ends = mesh.agg(F.max("j").alias("nj"), F.max("i").alias("ni"))
    return spread.crossJoin(F.broadcast(ends)).filter("j >= 0 and i >= 0 and j < nj and i < ni").drop("nj", "ni")  # a single row


def mesh_of_bounds(bounds: DataFrame, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The corners (j, i, values) of cells given by four corners each, once each."""
    j = F.col("j") + (F.col("n") >= 2).cast("int")
    i = F.col("i") + F.col("n").isin(1, 2).cast("int")
    return bounds.groupBy(j.alias("j"), i.alias("i")).agg(*[F.avg(v).alias(v) for v in values])


def centres(mesh: DataFrame, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Centres of the cells of a mesh of corners: means of four."""
    return cell_bounds2d(mesh, values).groupBy("j", "i").agg(*[F.avg(v).alias(v) for v in values])


def is_depth_up(df: DataFrame, by: list[str], level: str, depth: str) -> DataFrame:
    """Whether the first level is the deepest: by, up. Depths may be of either sign; null depths do not count."""
    rows = df.filter(F.col(depth).isNotNull())
    ends = rows.groupBy(*by).agg(F.min_by(depth, level).alias("a"), F.max_by(depth, level).alias("b"))
    return ends.select(*by, (F.abs("a") > F.abs("b")).alias("up"))


def make_depth_up(df: DataFrame, by: list[str], level: str, depth: str) -> DataFrame:
    """Levels numbered from the bottom up, columns that are so already as they were."""
    ends = df.groupBy(*by).agg(F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    told = df.join(is_depth_up(df, by, level, depth).withColumnRenamed("up", "_up"), by, "left").join(ends, by)
    turned = F.when(F.coalesce(F.col("_up"), F.lit(True)), F.col(level)).otherwise(F.col("_lo") + F.col("_hi") - F.col(level))
    return told.withColumn(level, turned).drop("_up", "_lo", "_hi")


def shift_grid(grid: DataFrame, along_i: bool = True, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """A grid moved on by half a cell: means of two neighbours; the last is extrapolated by half the last step."""
    part, order = ("j", "i") if along_i else ("i", "j")
    w = W.partitionBy(part).orderBy(order)
    moved = {v: F.when(F.lead(v).over(w).isNull(), F.col(v) + (F.col(v) - F.lag(v).over(w)) / 2).otherwise((F.col(v) + F.lead(v).over(w)) / 2) for v in values}
    return grid.select("j", "i", *[c.alias(v) for v, c in moved.items()])


def extend_grid(grid: DataFrame, ni: int, n: int, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``n`` more columns at either side of a grid of ``ni``, its positions continued by the last step."""
    out = None
    for v in values:
        one = extend(grid, [], v, n, ni, "extrap").withColumnRenamed("value", v)
        out = one if out is None else out.join(one, ["j", "i"])
    return out


def same_grids(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8, values: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One row: whether both grids have the same cells, at nearly the same places."""
    other = b.select(F.col("j"), F.col("i"), *[F.col(v).alias(f"_{v}") for v in values], F.lit(1).alias("_b"))
    both = a.withColumn("_a", F.lit(1)).join(other, ["j", "i"], "full")
    close = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for v in values:
        close = close & (F.abs(F.col(v) - F.col(f"_{v}")) <= atol + rtol * F.abs(F.col(f"_{v}")))
    return both.agg(F.coalesce(F.bool_and(F.coalesce(close, F.lit(False))), F.lit(True)).alias("same"))


def envelope(mesh: DataFrame) -> DataFrame:
    """The outer ring of a mesh (j, i, x, y), counter-clockwise from its first corner: n, x, y."""
    ends = mesh.agg(F.max("j").alias("nj"), F.max("i").alias("ni"))
    rows = mesh.crossJoin(F.broadcast(ends))  # a single row
    j, i, nj, ni = (F.col(c) for c in ("j", "i", "nj", "ni"))
    n = F.when((j == 0) & (i < ni), i).when((i == ni) & (j < nj), ni + j).when((j == nj) & (i > 0), 2 * ni + nj - i).when((i == 0) & (j > 0), 2 * ni + 2 * nj - j)
    return rows.withColumn("n", n).filter("n is not null").select("n", "x", "y")


def envelope_mask(points: DataFrame, mesh: DataFrame, x: str = "x", y: str = "y", out: str = "inside") -> DataFrame:
    """Whether points lie in the outer ring of a mesh. The ring, a row an edge cell, is one array that is sent along."""
    ring = envelope(mesh).agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("_ring"))
    return points.crossJoin(F.broadcast(ring)).withColumn(out, inside(F.col(x), F.col(y), F.col("_ring"))).drop("_ring")


def compress(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is there."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
