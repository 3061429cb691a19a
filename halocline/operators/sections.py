"""Sections through fields, points in four dimensions, curvilinear grids, merged grids, spectra and hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions.geo import haversine, in_quadrangle
from halocline.operators.grid import at_points
from halocline.operators.points import great_circle


def transect(field: DataFrame, value: str, ends: tuple[float, float, float, float], n: int, x0: float, dx: float, y0: float, dy: float, by: list[str] | None = None, method: str = "bilinear") -> DataFrame:
    """A field along the great circle from (lon, lat) to (lon, lat): by, k, lon, lat, distance, value.

    by: further axes of the field, as time or depth; the line is met with each of their values.
    """
    line = great_circle(n, *ends, field.sparkSession)
    line = line.withColumn("distance", haversine(F.lit(ends[0]), F.lit(ends[1]), F.col("lon"), F.col("lat")))
    if by:
        line = field.select(*by).distinct().crossJoin(F.broadcast(line))  # n + 1 rows
    return at_points(field, line, by or [], value, x0, dx, y0, dy, method, "lon", "lat")


def at_points_4d(field: DataFrame, points: DataFrame, value: str, axes: dict[str, tuple[float, float]], method: str = "linear") -> DataFrame:
    """A field on regular axes at points: axes by column, as {"x": (start, step), "t": ...}; the field has an index
    i_<axis> for each. ``linear`` in each axis: null if a corner that has weight is null or outside; ``nearest``: of two
    equally near the upper, null outside. Points must differ.
    """
    if method == "nearest":
        at = points.withColumns({f"i_{a}": F.floor((F.col(a) - start) / step + 0.5).cast("int") for a, (start, step) in axes.items()})
        keys = [f"i_{a}" for a in axes]
        return at.join(field.select(*keys, F.col(value).cast("double").alias("value")), keys, "left").select(*points.columns, "value")
    corners = [F.struct(F.lit(1.0).alias("w"), *[F.lit(0).alias(f"i_{a}") for a in axes])]
    rows = points.withColumn("_c", F.array(corners[0]))
    for a, (start, step) in axes.items():
        p = (F.col(a) - start) / step
        low = F.floor(p)

        rows = rows.withColumn("_c", F.flatten(F.transform("_c", _both_sides(a, list(axes), p, low))))
    keys = [f"i_{a}" for a in axes]
    spread = rows.withColumn("_c", F.explode(F.filter("_c", lambda c: c["w"] > 0))).select(*points.columns, F.col("_c.w").alias("_w"), *[F.col(f"_c.{k}").alias(k) for k in keys])
    joined = spread.join(field.select(*keys, F.col(value).cast("double").alias("_v")), keys, "left")
    sums = joined.groupBy(*points.columns).agg(F.sum(F.col("_v") * F.col("_w")).alias("s"), F.sum(F.col("_v").isNull().cast("int")).alias("m"))
    return sums.select(*points.columns, F.when(F.col("m") == 0, F.col("s")).alias("value"))


def _both_sides(axis: str, axes: list[str], p: Column, low: Column):
    """From a corner to the two that it becomes along one axis more."""

    def corner(c: Column, d: int) -> Column:
        w = (1 - (p - low)) if d == 0 else (p - low)
        return F.struct((c["w"] * w).alias("w"), *[((low + d).cast("int") if b == axis else c[f"i_{b}"]).alias(f"i_{b}") for b in axes])

    return lambda c: F.array(corner(c, 0), corner(c, 1))


def quads(grid: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Quadrangles of a curvilinear grid (j, i, x, y): j, i and corners c0 .. c3 as struct<x, y>, in turn."""
    at = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("j") - b).alias("j"), (F.col("i") - a).alias("i")) for k, (b, a) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])
    spread = grid.select(F.explode(places).alias("p"), at.alias("at"))
    found = spread.groupBy(F.col("p.j").alias("j"), F.col("p.i").alias("i")).agg(*[F.max(F.when(F.col("p.k") == k, F.col("at"))).alias(f"c{k}") for k in range(4)])
    return found.filter("c0 is not null and c1 is not null and c2 is not null and c3 is not null")


def relative_positions(grid: DataFrame, points: DataFrame, key: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Where points lie on a curvilinear grid: key, j, i, p, q; of several quadrangles the first. Points and
    quadrangles meet in squares of side ``size``, about that of a quadrangle."""
    q = quads(grid, x, y)
    span = {f"{f.__name__}_{c}": f(*[F.col(f"c{k}.{c}") for k in range(4)]) for f in (F.least, F.greatest) for c in ("x", "y")}
    cell = lambda c: F.floor(c / size).cast("long")
    spread = q.withColumns(span).withColumn("cx", F.explode(F.sequence(cell(F.col("least_x")), cell(F.col("greatest_x"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("least_y")), cell(F.col("greatest_y")))))
    p = points.select(key, F.col(x).alias("px"), F.col(y).alias("py"), cell(F.col(x)).alias("cx"), cell(F.col(y)).alias("cy"))
    at = in_quadrangle(F.col("px"), F.col("py"), [(F.col(f"c{k}.x"), F.col(f"c{k}.y")) for k in range(4)])
    inside = p.join(spread, ["cx", "cy"]).withColumn("at", at).filter("at.p between -1e-9 and 1 + 1e-9 and at.q between -1e-9 and 1 + 1e-9")
    first = inside.groupBy(key).agg(F.min(F.struct("j", "i", "at.p", "at.q")).alias("b"))
    return first.select(key, "b.j", "b.i", "b.p", "b.q")


def apply_positions(field: DataFrame, positions: DataFrame, key: str, value: str, method: str = "bilinear") -> DataFrame:
    """Values at positions found before; any number of fields can use them.

    ``bilinear``: null if a corner that has weight is null; ``nearest``: of the corner that p and q are nearest to, of
    equally near ones the upper; ``dstwgt``: inverse distances, in p and q, over the corners that are not null.
    """
    p, q = F.col("p"), F.col("q")
    places = ((0, 0), (0, 1), (1, 1), (1, 0))
    if method == "nearest":
        at = positions.select(key, (F.col("j") + (q >= 0.5).cast("int")).alias("j"), (F.col("i") + (p >= 0.5).cast("int")).alias("i"))
        return at.join(field.select("j", "i", F.col(value).cast("double").alias("value")), ["j", "i"], "left").select(key, "value")
    product = {(0, 0): (1 - p) * (1 - q), (0, 1): p * (1 - q), (1, 1): p * q, (1, 0): (1 - p) * q}
    weight = (lambda b, a: product[b, a]) if method == "bilinear" else (lambda b, a: 1 / F.greatest(F.hypot(p - a, q - b), F.lit(1e-12)))
    corner = F.array(*[F.struct((F.col("j") + b).alias("j"), (F.col("i") + a).alias("i"), weight(b, a).alias("w")) for b, a in places])
    spread = positions.select(key, F.explode(corner).alias("c")).select(key, "c.j", "c.i", "c.w").filter("abs(w) > 1e-12")
    joined = spread.join(field.select("j", "i", F.col(value).cast("double").alias("_v")), ["j", "i"], "left")
    v, w = F.col("_v"), F.col("w")
    if method == "bilinear":
        return joined.groupBy(key).agg(F.when(F.sum(v.isNull().cast("int")) == 0, F.sum(v * w)).alias("value"))
    return joined.groupBy(key).agg((F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))).alias("value"))


def merge_fields(sources: list[DataFrame], value: str) -> DataFrame:
    """Fields on one grid (j, i, value, cover 0 .. 1), bottom to top: each takes of a cell what those above leave.

    The result is the mean weighted by what each takes; cells that none covers are left out.
    """
    every = None
    for rank, s in enumerate(reversed(sources)):
        one = s.filter(F.col(value).isNotNull()).select("j", "i", F.struct(F.lit(rank).alias("rank"), F.col(value).cast("double").alias("v"), F.col("cover").cast("double").alias("c")).alias("s"))
        every = one if every is None else every.unionByName(one)
    held = every.groupBy("j", "i").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most one a source
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("got"))

    def take(acc: Column, s: Column) -> Column:
        part = F.least(s["c"], 1 - acc["got"])
        return F.struct((acc["sum"] + part * s["v"]).alias("sum"), (acc["got"] + part).alias("got"))

    done = held.select("j", "i", F.aggregate("s", zero, take).alias("a")).filter("a.got > 0")
    return done.select("j", "i", (F.col("a.sum") / F.col("a.got")).alias(value))


def spectrum(field: DataFrame, by: list[str], value: str, dx: float, dy: float) -> DataFrame:
    """Power of complete fields (j, i) by rings of wavenumber: by, k, power. The mean of a field has no power.

    The transform goes along the rows first and then along the columns, so a task holds one line of a field at a time."""
    kinds = [f"`{b}` {field.schema[b].dataType.simpleString()}" for b in by]

    def rows(part: pd.DataFrame) -> pd.DataFrame:
        f = np.fft.fft(part.sort_values("i")[value].to_numpy(float))
        return pd.DataFrame({**{b: part[b].iat[0] for b in by}, "j": part["j"].iat[0], "ki": np.arange(len(f)), "nx": len(f), "re": f.real, "im": f.imag})

    def columns(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("j")
        f, nx, ki = np.fft.fft(part["re"].to_numpy() + 1j * part["im"].to_numpy()), int(part["nx"].iat[0]), int(part["ki"].iat[0])
        ny = len(f)
        power = np.abs(f) ** 2 / (nx * ny) ** 2
        power[0] *= ki != 0
        longest = max(nx * dx, ny * dy)
        ring = np.rint(np.hypot(np.fft.fftfreq(nx, dx)[ki], np.fft.fftfreq(ny, dy)) * longest).astype(int)
        return pd.DataFrame({**{b: part[b].iat[0] for b in by}, "ring": ring, "longest": longest, "power": power})

    lines = field.groupBy(*by, "j").applyInPandas(rows, ", ".join([*kinds, "j int", "ki int", "nx int", "re double", "im double"]))
    parts = lines.groupBy(*by, "ki").applyInPandas(columns, ", ".join([*kinds, "ring int", "longest double", "power double"]))
    found = parts.groupBy(*by, "longest", "ring").agg(F.sum("power").alias("power"))
    every = found.groupBy(*by, "longest").agg(F.max("ring").alias("last")).withColumn("ring", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    return every.join(found, [*by, "longest", "ring"], "left").select(*by, (F.col("ring") / F.col("longest")).alias("k"), F.coalesce("power", F.lit(0.0)).alias("power"))


def wavenumbers(spark, nx: int, ny: int, dx: float, dy: float) -> DataFrame:
    """kj, ki, kx, ky, k: the angular wavenumbers of an ny x nx field, in the order of its transform."""
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("kj"), (F.col("id") % nx).cast("int").alias("ki"))
    turn = lambda c, n, d: F.when(F.col(c) * 2 < n, F.col(c)).otherwise(F.col(c) - n) * (2 * math.pi / (n * d))
    return cells.withColumns({"kx": turn("ki", nx, dx), "ky": turn("kj", ny, dy)}).withColumn("k", F.hypot("kx", "ky"))


def summed_spectrum(a: DataFrame, b: DataFrame, by: list[str], value: str, dx: float, dy: float) -> DataFrame:
    """Power of two fields together by rings of wavenumber: by, k, power; the sum of their spectra."""
    both = spectrum(a, by, value, dx, dy).unionByName(spectrum(b, by, value, dx, dy))
    return both.groupBy(*by, "k").agg(F.sum("power").alias("power"))


def hull(df: DataFrame, x: str = "x", y: str = "y", parts: int = 64) -> DataFrame:
    """Corners of the convex hull, counter-clockwise from the leftmost: n, x, y. Every task keeps the hull of the
    batches it has seen; the hulls of the tasks meet in ``parts``, and the corners that are left in one."""
    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(rows["x"], rows["y"], strict=True)))
        if len(pts) > 2:
            chains = []
            for run in (pts, pts[::-1]):
                chain: list[tuple[float, float]] = []
                for p in run:
                    while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                        chain.pop()
                    chain.append(p)
                chains.append(chain[:-1])
            pts = chains[0] + chains[1]
        return pd.DataFrame({"n": range(len(pts)), "x": [p[0] for p in pts], "y": [p[1] for p in pts]})

    schema = "n int, x double, y double"
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"x": [], "y": []})
        for batch in batches:
            held = corners(pd.concat([held, batch[["x", "y"]]]))[["x", "y"]]
        yield held

    few = points.mapInPandas(partial, "x double, y double")
    some = few.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts))).groupBy("part").applyInPandas(corners, schema)
    return some.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(corners, schema)


def resolution(grid: DataFrame, lon: str = "lon", lat: str = "lat", accuracy: int = 10_000) -> DataFrame:
    """Median steps in metres along i and along j: dx, dy; of ranks at most 1 / accuracy of the cells off."""
    from pyspark.sql import Window as W

    right, above = W.partitionBy("j").orderBy("i"), W.partitionBy("i").orderBy("j")
    x, y = F.col(lon), F.col(lat)
    steps = grid.select(haversine(x, y, F.lead(lon).over(right), F.lead(lat).over(right)).alias("dx"), haversine(x, y, F.lead(lon).over(above), F.lead(lat).over(above)).alias("dy"))
    return steps.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in ("dx", "dy")])


def refine(field: DataFrame, value: str, factor: int, nj: int, ni: int) -> DataFrame:
    """A field on a grid ``factor`` times as fine, bilinear between the nodes."""
    spark = field.sparkSession
    fine = spark.range((nj - 1) * factor + 1).select(F.col("id").cast("int").alias("fj")).crossJoin(spark.range((ni - 1) * factor + 1).select(F.col("id").cast("int").alias("fi")))
    at = fine.select("fj", "fi", (F.col("fi") / factor).alias("x"), (F.col("fj") / factor).alias("y"))
    return at_points(field, at, [], value, 0.0, 1.0, 0.0, 1.0).select(F.col("fj").alias("j"), F.col("fi").alias("i"), F.col("value").alias(value))


def wavelength(k: Column) -> Column:
    return 2 * math.pi / k
