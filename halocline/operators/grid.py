"""Fields on grids: rows (by, j, i, value) of a dense index. Stencils join a field with itself shifted by index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.functions.units import EARTH_RADIUS, GRAVITY
from halocline.functions.seawater import coriolis
from halocline.operators.cut import Steps


def neighbours(df: DataFrame, by: list[str], offsets: list[tuple[int, int, float]]) -> DataFrame:
    """Each row once for every (dj, di, weight), placed at the cell whose neighbour it is; adds dj, di, w."""
    pieces = F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di"), F.lit(float(w)).alias("w")) for dj, di, w in offsets])
    spread = df.withColumn("_p", F.explode(pieces))
    return spread.withColumns({"j": F.col("j") - F.col("_p.dj"), "i": F.col("i") - F.col("_p.di"), "dj": F.col("_p.dj"), "di": F.col("_p.di"), "w": F.col("_p.w")}).drop("_p")


def filter2d(df: DataFrame, by: list[str], value: str, weights: list[list[float]], mask: str = "same", out: str = "filtered") -> DataFrame:
    """Sum of weight x valid value over sum of valid weight on a grid; ``same`` keeps nulls, ``minimal`` fills them,
    ``maximal`` needs all. One aggregation, whatever the size of the window."""
    hj, hi = len(weights) // 2, len(weights[0]) // 2
    offsets = [(dj - hj, di - hi, w) for dj, row in enumerate(weights) for di, w in enumerate(row) if w or (dj, di) == (hj, hi)]
    spread = neighbours(df.select(*by, "j", "i", F.col(value).alias("_v")), by, offsets)
    own = F.max(F.when((F.col("dj") == 0) & (F.col("di") == 0), F.struct(F.lit(1).alias("is"), F.col("_v").alias("v"))))
    valid = F.when(F.col("_v").isNotNull(), F.col("w"))
    sums = spread.groupBy(*by, "j", "i").agg(own.alias("own"), F.sum(F.col("_v") * F.col("w")).alias("a"), F.sum(valid).alias("b"), F.sum("w").alias("all")).filter("own is not null")
    result = F.col("a") / F.nullif(F.col("b"), F.lit(0.0))
    if mask == "same":
        result = F.when(F.col("own.v").isNotNull(), result)
    elif mask == "maximal":
        result = F.when(F.col("b") >= F.col("all") - 1e-12, result)
    return sums.select(*by, "j", "i", result.alias(out))


def shapiro2d(corners: float = 0.5) -> list[list[float]]:
    return [[corners, 1.0, corners], [1.0, 2.0, 1.0], [corners, 1.0, corners]]


def gaussian2d(nx: int, ny: int | None = None, sx: float = 1 / 3, sy: float = 1 / 3, rmax: float = 3.0) -> list[list[float]]:
    """ny x nx (odd) weights exp(-(x^2 / sx^2 + y^2 / sy^2)), none below exp(-rmax^2). A deviation below 1 is a share of
    half the size, else a number of cells."""
    ny = ny or nx
    sx, sy = (sx * (nx // 2) if sx < 1 else sx), (sy * (ny // 2) if sy < 1 else sy)

    def weight(y: int, x: int) -> float:
        w = math.exp(-(x * x / sx**2 + y * y / sy**2))
        return w if w >= math.exp(-(rmax**2)) else 0.0

    return [[weight(y, x) for x in range(-(nx // 2), nx // 2 + 1)] for y in range(-(ny // 2), ny // 2 + 1)]


def at_points(field: DataFrame, points: DataFrame, by: list[str], value: str, x0: float, dx: float, y0: float, dy: float, method: str = "bilinear", x: str = "x", y: str = "y",
              geo: bool = False) -> DataFrame:
    """A field on a regular grid (x = x0 + i dx, y = y0 + j dy) at points: one equi-join of the corners.

    ``bilinear``: null if a corner that has weight is null or outside; ``dstwgt``: inverse distance over the valid
    corners, in cells, or if ``geo`` in degrees, those of x shrunk by cos(y); ``nearest``. Points keep all their
    columns; their rows must differ.
    """
    px, py = (F.col(x) - x0) / dx, (F.col(y) - y0) / dy
    i0, j0 = F.floor(px).cast("int"), F.floor(py).cast("int")
    if method == "nearest":
        at = points.withColumns({"i": F.floor(px + 0.5).cast("int"), "j": F.floor(py + 0.5).cast("int")})
        return at.join(field.select(*by, "j", "i", F.col(value).cast("double").alias("value")), [*by, "j", "i"], "left").drop("i", "j")
    ux, uy = (dx * F.cos(F.radians(F.col(y))), F.lit(dy)) if geo else (F.lit(1.0), F.lit(1.0))
    corner = F.array(*[F.struct((j0 + b).alias("j"), (i0 + a).alias("i"), (F.abs(1 - a - (px - i0)) * F.abs(1 - b - (py - j0))).alias("w"), F.hypot((px - i0 - a) * ux, (py - j0 - b) * uy).alias("d")) for b in (0, 1) for a in (0, 1)])
    spread = points.withColumn("_c", F.explode(corner)).withColumns({"j": F.col("_c.j"), "i": F.col("_c.i"), "_w": F.col("_c.w"), "_d": F.col("_c.d")}).drop("_c")
    v = F.col("_v")
    joined = spread.join(field.select(*by, "j", "i", F.col(value).cast("double").alias("_v")), [*by, "j", "i"], "left")
    keys = [c for c in points.columns]
    if method == "bilinear":
        total = joined.filter("_w > 0").groupBy(*keys).agg(F.sum(v * F.col("_w")).alias("s"), F.sum(v.isNull().cast("int")).alias("missing"))
        return total.select(*keys, F.when(F.col("missing") == 0, F.col("s")).alias("value"))
    inverse = 1 / F.greatest(F.col("_d"), F.lit(1e-12))
    total = joined.filter(v.isNotNull()).groupBy(*keys).agg((F.sum(v * inverse) / F.sum(inverse)).alias("value"))
    return points.join(total, keys, "left")


def regrid_average(field: DataFrame, by: list[str], value: str, fj: int, fi: int, out: str = "value") -> DataFrame:
    """Means over blocks of fj x fi cells: a coarser grid whose cells hold whole cells of the finer."""
    return field.groupBy(*by, F.floor(F.col("j") / fj).cast("int").alias("j"), F.floor(F.col("i") / fi).cast("int").alias("i")).agg(F.avg(value).alias(out))


def extend(field: DataFrame, by: list[str], value: str, n: int, ni: int, mode: str = "same") -> DataFrame:
    """``n`` ghost columns on either side of the ``ni`` columns 0 .. ni - 1: ``same`` repeats the edge, ``cyclic``
    continues around, ``extrap`` follows the last two, ``masked`` is null."""
    base = field.select(*by, "j", "i", F.col(value).cast("double").alias("value"))
    if mode == "cyclic":
        left = base.filter(F.col("i") >= ni - n).withColumn("i", F.col("i") - ni)
        right = base.filter(F.col("i") < n).withColumn("i", F.col("i") + ni)
        return base.unionByName(left).unionByName(right)
    edge = base.filter(F.col("i").isin(0, 1, ni - 2, ni - 1)).groupBy(*by, "j").agg(*[F.max(F.when(F.col("i") == k, F.col("value"))).alias(a) for k, a in ((0, "a"), (1, "b"), (ni - 2, "y"), (ni - 1, "z"))])
    ghosts = edge.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    left = {"same": F.col("a"), "extrap": F.col("a") + F.col("k") * (F.col("a") - F.col("b")), "masked": F.lit(None).cast("double")}[mode]
    right = {"same": F.col("z"), "extrap": F.col("z") + F.col("k") * (F.col("z") - F.col("y")), "masked": F.lit(None).cast("double")}[mode]
    parts = [ghosts.select(*by, "j", i.cast("int").alias("i"), v.alias("value")) for i, v in ((-F.col("k"), left), (F.col("k") + ni - 1, right))]
    return base.unionByName(parts[0]).unionByName(parts[1])


def shift_columns(field: DataFrame, n: int, ni: int) -> DataFrame:
    """Turns a cyclic grid of ``ni`` columns by ``n``."""
    return field.withColumn("i", F.pmod(F.col("i") - n, F.lit(ni)).cast("int"))


# Bits of the coast code, by (dj, di) of the neighbour that is land.
SIDES = {(1, 0): 4, (0, -1): 8, (0, 1): 2, (-1, 0): 1}
CORNERS = {(1, -1): 128, (1, 1): 64, (-1, -1): 16, (-1, 1): 32}


def coast(field: DataFrame, by: list[str], land: Column) -> DataFrame:
    """Code of each water cell: bits of the sides that are land, or else of the corners; 0 for land and open water."""
    base = field.select(*by, "j", "i", land.cast("int").alias("_l"))
    spread = neighbours(base, by, [(0, 0, 0), *[(*k, b) for k, b in SIDES.items()], *[(*k, 1000 * b) for k, b in CORNERS.items()]])
    w = F.col("w")
    sums = spread.groupBy(*by, "j", "i").agg(
        F.max(F.when(w == 0, F.col("_l"))).alias("own"), F.sum(F.when((w > 0) & (w < 1000), w * F.col("_l"))).alias("sides"), F.sum(F.when(w >= 1000, w * F.col("_l") / 1000)).alias("corners")
    )
    sides = F.coalesce(F.col("sides"), F.lit(0.0))
    code = F.when(F.col("own") == 1, 0).when(sides > 0, sides).otherwise(F.coalesce(F.col("corners"), F.lit(0.0)))
    return sums.filter("own is not null").select(*by, "j", "i", code.cast("int").alias("code"))


def cell_area(lat: Column, dlon: float, dlat: float) -> Column:
    """Of a regular cell, in square metres."""
    metre = math.pi * EARTH_RADIUS / 180
    return dlon * dlat * metre * metre * F.cos(F.radians(lat))


def geostrophy(ssh: DataFrame, by: list[str], value: str, lat: Column, dx: float, dy: float) -> DataFrame:
    """Barotropic geostrophic velocities on a C grid: u at V points, v at U points. lat: of row j; dx, dy in metres."""
    f = coriolis(lat)
    p = ssh.withColumn("_p", GRAVITY / f * F.col(value))
    up, right = W.partitionBy(*by, "i").orderBy("j"), W.partitionBy(*by, "j").orderBy("i")
    return p.withColumns({"u": -(F.lead("_p").over(up) - F.col("_p")) / dy, "v": (F.lead("_p").over(right) - F.col("_p")) / dx}).select(*by, "j", "i", "u", "v")


def kinetic_energy(uv: DataFrame, by: list[str]) -> DataFrame:
    """At T points, from u and v of the cell and of the ones before: half the mean squares of the valid ones."""
    back_u, back_v = F.lag("u").over(W.partitionBy(*by, "i").orderBy("j")), F.lag("v").over(W.partitionBy(*by, "j").orderBy("i"))
    both = uv.withColumns({"bu": back_u, "bv": back_v})

    def mean_square(a: str, b: str) -> Column:
        n = F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int")
        zero = F.lit(0.0)
        return (F.coalesce(F.col(a) * F.col(a), zero) + F.coalesce(F.col(b) * F.col(b), zero)) / F.nullif(n, F.lit(0))

    return both.select(*by, "j", "i", ((mean_square("u", "bu") + mean_square("v", "bv")) / 2).alias("ke"))


#: place of a variable on a grid, as offsets (x, y, z) from T in cells
LOCATIONS = {"A": dict.fromkeys("tuvwf", (0.0, 0.0, 0.0)), "C": {"t": (0.0, 0.0, 0.0), "u": (0.5, 0.0, 0.0), "v": (0.0, 0.5, 0.0), "f": (0.5, 0.5, 0.0), "w": (0.0, 0.0, 0.5)}}


def to_location(field: DataFrame, by: list[str], value: str, place: str, grid: str = "C") -> DataFrame:
    """A field at T points at another place of the grid: means of two neighbours along each axis that is offset; the
    outermost is extrapolated."""
    x, y, _ = LOCATIONS[grid][place]
    for offset, part, order in ((x, "j", "i"), (y, "i", "j")):
        if offset:
            w = W.partitionBy(*by, part).orderBy(order)
            after, before = F.lead(value).over(w), F.lag(value).over(w)
            field = field.withColumn(value, F.when(F.lead(F.lit(1)).over(w).isNull(), F.col(value) + (F.col(value) - before) / 2).otherwise((F.col(value) + after) / 2))
    return field


def is_rectangular(grid: DataFrame, lon: str = "lon", lat: str = "lat", tolerance: float = 0.01) -> DataFrame:
    """One row: whether lon hangs on i alone and lat on j alone, to a share of the mean steps."""
    row, column = W.partitionBy("j").orderBy("i"), W.partitionBy("i").orderBy("j")
    steps = grid.withColumns({"dx": F.lead(lon).over(row) - F.col(lon), "dy": F.lead(lat).over(column) - F.col(lat)})
    by_i = steps.groupBy("i").agg(F.stddev_pop(lon).alias("s")).agg(F.max("s").alias("sx"))
    by_j = steps.groupBy("j").agg(F.stddev_pop(lat).alias("s")).agg(F.max("s").alias("sy"))
    mean = steps.agg(F.abs(F.avg("dx")).alias("mx"), F.abs(F.avg("dy")).alias("my"))
    one = mean.crossJoin(by_i).crossJoin(by_j)  # a single row each
    return one.select(((F.col("sx") < tolerance * F.col("mx")) & (F.col("sy") < tolerance * F.col("my"))).alias("rectangular"))


def gradient(field: DataFrame, by: list[str], value: str, dx: float, dy: float, direction: float | None = None, out: str = "gradient") -> DataFrame:
    """Size of the slope, or the slope towards ``direction`` (degrees, mathematical): centred differences, one-sided at
    the edges."""
    def slope(part: str, order: str, step: float) -> Column:
        w = W.partitionBy(*by, part).orderBy(order)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        return F.when(first, after - here).when(last, here - before).otherwise((after - before) / 2) / step

    both = field.withColumns({"_gx": slope("j", "i", dx), "_gy": slope("i", "j", dy)})
    if direction is None:
        result = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    else:
        a = math.radians(direction)
        result = F.col("_gx") * math.cos(a) + F.col("_gy") * math.sin(a)
    return both.withColumn(out, result).drop("_gx", "_gy")


def erode(field: DataFrame, by: list[str], value: str, wanted: Column, rounds: int = 10, corners: float = 0.0) -> DataFrame:
    """Fills null cells that are ``wanted`` from their neighbours, by smoothing, one ring of cells a round.

    Every round is written, and the last is that in which no cell is left to fill.
    """
    weights = [[corners, 1.0, corners], [1.0, 0.0, 1.0], [corners, 1.0, corners]]
    cells = field.select(*by, "j", "i", F.col(value).cast("double").alias(value), wanted.alias("_wanted"))
    steps = Steps(field.sparkSession, "erode")
    for _ in range(rounds):
        near = filter2d(cells, by, value, weights, "minimal", "_near")
        cells = cells.join(near, [*by, "j", "i"]).withColumn(value, F.when(F.col("_wanted"), F.coalesce(value, "_near")).otherwise(F.col(value))).drop("_near")
        cells = steps.write(cells)
        if cells.filter(F.col("_wanted") & F.col(value).isNull()).isEmpty():
            break
    return cells.drop("_wanted")


def make_grid(spark, nx: int, ny: int, x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = 1.0) -> DataFrame:
    """A regular grid: j, i, x, y."""
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("j"), (F.col("id") % nx).cast("int").alias("i"))
    return cells.withColumns({"x": x0 + F.col("i") * dx, "y": y0 + F.col("j") * dy})


def section_extrema(field: DataFrame, by: list[str], value: str, along: str) -> DataFrame:
    """Where a variable is least and greatest: by, low, low_at, high, high_at; of equal cells the first."""
    v, k = F.col(value), F.col(along)
    found = field.filter(v.isNotNull()).groupBy(*by).agg(F.min(F.struct(v.alias("v"), k.alias("k"))).alias("a"), F.max(F.struct(v.alias("v"), (-k).alias("k"))).alias("b"))
    return found.select(*by, F.col("a.v").alias("low"), F.col("a.k").alias("low_at"), F.col("b.v").alias("high"), (-F.col("b.k")).alias("high_at"))


def grid_of_axes(x: DataFrame, y: DataFrame, index: str = "k", position: str = "x") -> DataFrame:
    """The grid of two axes (index, position): j, i, x, y, a row a cell. Axes are small; the longer one is not sent."""
    rows = y.select(F.col(index).cast("int").alias("j"), F.col(position).cast("double").alias("y"))
    columns = x.select(F.col(index).cast("int").alias("i"), F.col(position).cast("double").alias("x"))
    return rows.crossJoin(columns).select("j", "i", "x", "y")  # the cells themselves


def on_grid(field: DataFrame, grid: DataFrame) -> DataFrame:
    """A field (j, i, ...) with the positions of its cells; a cell that the grid lacks has none."""
    return field.join(grid.select("j", "i", "x", "y"), ["j", "i"], "left")
