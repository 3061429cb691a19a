"""Stencils along one axis: filters, differences, bounds, gaps. All are windows over ``by`` in the order of ``order``.

A row is a cell of a dense axis; ``regular`` makes one of an axis with holes. Operators chained over the same ``by``
share one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _window(by: list[str], order: str):
    return W.partitionBy(*by).orderBy(order)


# weights of the named filters


def shapiro() -> list[float]:
    return [1.0, 2.0, 1.0]


def hamming(m: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (m - 1)) for i in range(m)]


def hanning(m: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / (m - 1)) for i in range(m)]


def bartlett(m: int) -> list[float]:
    return [1 - abs(2 * i / (m - 1) - 1) for i in range(m)]


def blackman(m: int) -> list[float]:
    return [0.42 - 0.5 * math.cos(2 * math.pi * i / (m - 1)) + 0.08 * math.cos(4 * math.pi * i / (m - 1)) for i in range(m)]


def kaiser(m: int, beta: float) -> list[float]:
    def bessel(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, 60):
            term *= (x / 2 / k) ** 2
            total += term
        return total

    return [bessel(beta * math.sqrt(max(0.0, 1 - (2 * i / (m - 1) - 1) ** 2))) / bessel(beta) for i in range(m)]


def gaussian(m: int) -> list[float]:
    """``m``, an odd number, weights exp(-(i / m)^2) around the middle one."""
    return [math.exp(-(i * i) / (m * m)) for i in range(-(m // 2), m // 2 + 1)]


def filter1d(df: DataFrame, by: list[str], order: str, value: str, weights: list[float], mask: str | float = "same", out: str = "filtered") -> DataFrame:
    """Sum of weight x valid value over sum of valid weight; the weights are centred.

    mask: ``same`` keeps the nulls of the input, ``minimal`` has a value wherever one is valid, ``maximal`` only where
    all are; a number is the share of missing weight that is tolerated. Beyond the ends there is no weight.
    """
    v, half = F.col(value), len(weights) // 2
    frame = _window(by, order).rowsBetween(-half, half)
    # a frame holds the window, which is shorter at the ends: its weights are those of the cells that are there
    held = F.collect_list(F.struct(v.cast("double").alias("v"))).over(frame)
    before = F.count(F.lit(1)).over(_window(by, order).rowsBetween(-half, -1)) if half else F.lit(0)
    kernel = F.slice(F.array(*[F.lit(float(k)) for k in weights]), (half - before + 1).cast("int"), F.size(held))
    cells = F.zip_with(held, kernel, lambda x, k: F.struct(x["v"].alias("v"), k.alias("k")))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("used"), F.lit(0.0).alias("inside"))
    sums = F.aggregate(cells, zero, lambda acc, c: F.struct(
        (acc["total"] + F.coalesce(c["v"] * c["k"], F.lit(0.0))).alias("total"), (acc["used"] + F.when(c["v"].isNotNull(), c["k"]).otherwise(0.0)).alias("used"), (acc["inside"] + c["k"]).alias("inside")
    ))
    df = df.withColumn("_sums", sums)
    total, used, inside = F.col("_sums.total"), F.col("_sums.used"), F.col("_sums.inside")
    result = total / F.nullif(used, F.lit(0.0))
    if mask == "same":
        result = F.when(v.isNotNull(), result)
    elif mask == "maximal":
        result = F.when(used >= inside - 1e-12, result)
    elif mask != "minimal":
        result = F.when(1 - used / inside <= float(mask), result)
    return df.withColumn(out, result).drop("_sums")


def filter_long(df: DataFrame, by: list[str], order: str, value: str, weights: list[float], mask: str | float = "same", chunk: int = 1_000_000, out: str = "filtered") -> DataFrame:
    """As ``filter1d``, for series too long for one task: ``order`` is a dense whole number, and chunks of it are filtered
    side by side, each with the cells that its window reaches in its neighbours."""
    half, k = len(weights) // 2, F.floor(F.col(order) / chunk)
    reach = F.array(F.floor((F.col(order) - half) / chunk), k, F.floor((F.col(order) + half) / chunk))
    spread = df.withColumn("_chunk", F.explode(F.array_distinct(reach)))
    done = filter1d(spread, [*by, "_chunk"], order, value, weights, mask, out)
    return done.filter(F.col("_chunk") == k).drop("_chunk")


def running_average(df: DataFrame, by: list[str], order: str, value: str, length: int, out: str = "average", keep_nulls: bool = True) -> DataFrame:
    """Mean of the valid values of ``length`` cells around each; the span shrinks evenly near the ends."""
    half = length // 2
    held = F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(_window(by, order).rowsBetween(-half, half))
    before = F.count(F.lit(1)).over(_window(by, order).rowsBetween(-half, -1)) if half else F.lit(0)
    df = df.withColumns({"_held": held, "_before": before})
    reach = F.least(F.col("_before"), F.size("_held") - F.col("_before") - 1)
    near = F.slice("_held", (F.col("_before") - reach + 1).cast("int"), (2 * reach + 1).cast("int"))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    mean = F.aggregate(near, zero, lambda acc, c: F.struct((acc["total"] + F.coalesce(c["v"], F.lit(0.0))).alias("total"), (acc["n"] + c["v"].isNotNull().cast("int")).alias("n")), lambda acc: acc["total"] / F.nullif(acc["n"], F.lit(0)))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), mean) if keep_nulls else mean).drop("_held", "_before")


def derivative(df: DataFrame, by: list[str], order: str, value: str, position: str | None = None, out: str = "derivative") -> DataFrame:
    """Centred differences, one-sided at the ends; per unit of ``position``, or per step (ends not halved)."""
    w = _window(by, order)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    if position:
        x, xb, xa = F.col(position), F.lag(position).over(w), F.lead(position).over(w)
        result = F.when(first, (after - here) / (xa - x)).when(last, (here - before) / (x - xb)).otherwise((after - before) / (xa - xb))
    else:
        result = F.when(first, after - here).when(last, here - before).otherwise((after - before) / 2)
    return df.withColumn(out, result)


def bounds(df: DataFrame, by: list[str], order: str, position: str) -> DataFrame:
    """lo and hi of each cell: half way to the neighbours, as far beyond the ends as within."""
    w = _window(by, order)
    x, before, after = F.col(position), F.lag(position).over(w), F.lead(position).over(w)
    lo = F.when(before.isNull(), x - (after - x) / 2).otherwise((before + x) / 2)
    hi = F.when(after.isNull(), x + (x - before) / 2).otherwise((x + after) / 2)
    return df.withColumns({"lo": lo, "hi": hi})


def mesh_weights(df: DataFrame, by: list[str], order: str, position: str, out: str = "weight") -> DataFrame:
    """Widths of cells: half the way between both neighbours, and the way to the only one at the ends."""
    w = _window(by, order)
    before, after = F.col(position) - F.lag(position).over(w), F.lead(position).over(w) - F.col(position)
    return df.withColumn(out, F.abs(F.when(before.isNull(), after).when(after.isNull(), before).otherwise((before + after) / 2)))


def layer_thickness(df: DataFrame, by: list[str], order: str, depth: str, out: str = "dz") -> DataFrame:
    """Between a level and the one before; the first takes the next one's."""
    w = _window(by, order)
    back = F.abs(F.col(depth) - F.lag(depth).over(w))
    return df.withColumn(out, F.coalesce(back, F.abs(F.lead(depth).over(w) - F.col(depth))))


def depth_of_layers(df: DataFrame, by: list[str], order: str, dz: str, top: Column | None = None, out: str = "depth") -> DataFrame:
    """Edges of layers below ``top`` (0): minus the thicknesses added up from the surface, in the order of ``order``."""
    below = F.sum(dz).over(_window(by, order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, (F.lit(0.0) if top is None else top) - below)


def unwrap(df: DataFrame, by: list[str], order: str, lon: str, out: str = "lon_unwrapped") -> DataFrame:
    """Longitudes without jumps of more than half a turn."""
    w = _window(by, order)
    step = F.col(lon) - F.lag(lon).over(w)
    turn = F.when(step > 180, -360).when(step < -180, 360).otherwise(0)
    return df.withColumn("_turn", turn).withColumn(out, F.col(lon) + F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_turn")


def fill_gaps(df: DataFrame, by: list[str], order: str, value: str, position: Column, max_gap: int = 0, out: str = "filled") -> DataFrame:
    """Nulls between valid cells on a straight line over the number ``position``; runs longer than ``max_gap`` cells
    stay, if it is not 0. Nulls beyond the first and last valid cell stay."""
    w = _window(by, order)
    rows = df.withColumns({"_x": position, "_i": F.row_number().over(w)})
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(value).alias("v"), F.col("_i").alias("i")))
    rows = rows.withColumns({
        "_b": F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_a": F.last(known, ignorenulls=True).over(W.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)),
    })
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_x") - F.col("_b.x")) / (F.col("_a.x") - F.col("_b.x"))
    short = F.lit(True) if not max_gap else (F.col("_a.i") - F.col("_b.i") - 1 <= max_gap)
    return rows.withColumn(out, F.coalesce(F.col(value), F.when(short, line))).drop("_x", "_i", "_a", "_b")


def regular(df: DataFrame, by: list[str], ts: str, step: str) -> DataFrame:
    """A row for every ``step`` (as '1 hour') from the first to the last time of each group; new rows are null else."""
    span = df.groupBy(*by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    axis = span.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {step}"))).alias(ts))
    return axis.join(df, [*by, ts], "left")


def gaps(df: DataFrame, by: list[str], ts: str, step_seconds: float, tolerance: float = 0.1) -> DataFrame:
    """Holes of a time axis: last time before, first time after, and steps that are missing."""
    after = F.lead(ts).over(_window(by, ts))
    found = df.select(*by, F.col(ts).alias("before"), after.alias("after")).withColumn("seconds", F.timestamp_diff("MICROSECOND", F.col("before"), F.col("after")) / 1e6)
    return found.filter(F.col("seconds") > step_seconds * (1 + tolerance)).select(*by, "before", "after", (F.round(F.col("seconds") / step_seconds) - 1).cast("long").alias("missing"))


def time_step(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Median step of a time axis, in seconds."""
    step = df.select(*by, (F.timestamp_diff("MICROSECOND", F.col(ts), F.lead(ts).over(_window(by, ts))) / 1e6).alias("step"))
    return step.groupBy(*by).agg(F.median("step").alias("step"))


def is_regular(df: DataFrame, by: list[str], order: str, position: str, tolerance: float = 0.05) -> DataFrame:
    """Whether all steps of an axis are within a share of their median."""
    step = df.select(*by, (F.lead(position).over(_window(by, order)) - F.col(position)).alias("step"))
    return step.groupBy(*by).agg(F.median("step").alias("m"), F.min("step").alias("lo"), F.max("step").alias("hi")).select(
        *by, (F.greatest(F.abs(F.col("hi") - F.col("m")), F.abs(F.col("lo") - F.col("m"))) <= tolerance * F.abs("m")).alias("regular")
    )


def crossings(df: DataFrame, by: list[str], order: str, value: str, position: Column, level: float = 0.0) -> DataFrame:
    """Where ``value`` passes ``level`` between two cells, on a straight line: position and direction (1 up, -1 down)."""
    w = _window(by, order)
    rows = df.select(*by, F.col(order).alias("_o"), position.alias("x"), (F.col(value) - level).alias("v"))
    w = W.partitionBy(*by).orderBy("_o")
    rows = rows.withColumns({"nx": F.lead("x").over(w), "nv": F.lead("v").over(w)})
    passed = rows.filter(((F.col("v") < 0) & (F.col("nv") >= 0)) | ((F.col("v") > 0) & (F.col("nv") <= 0)))
    at = F.col("x") + (F.col("nx") - F.col("x")) * F.col("v") / (F.col("v") - F.col("nv"))
    return passed.select(*by, at.alias("position"), F.signum(F.col("nv") - F.col("v")).cast("int").alias("sign"))


def extrema(df: DataFrame, by: list[str], order: str, anomaly: str) -> DataFrame:
    """The largest cell of every run of positive anomalies, the smallest of every run of negative ones.

    An extremum at the edge of its run, and the runs at either end of the series, give none.
    """
    w = W.partitionBy(*by).orderBy(order)
    up = F.when(F.col(anomaly) >= 0, 1).otherwise(-1)
    rows = df.filter(F.col(anomaly).isNotNull()).select(*by, order, F.col(anomaly).alias("v"), up.alias("sign"))
    rows = rows.withColumn("new", F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = F.max_by(F.struct(order, "v"), F.struct(F.col("v") * F.col("sign"), F.col(order)))
    runs = rows.groupBy(*by, "run", "sign").agg(at.alias("at"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    inner = runs.filter((F.col(f"at.{order}") > F.col("lo")) & (F.col(f"at.{order}") < F.col("hi")))
    return inner.select(*by, F.col(f"at.{order}").alias(order), F.col("at.v").alias("value"), "sign")


def shift_half(df: DataFrame, by: list[str], order: str, value: str, out: str = "shifted") -> DataFrame:
    """Values half a cell on: the mean of two neighbours; the last is extrapolated by the last step."""
    w = _window(by, order)
    after, before = F.lead(value).over(w), F.lag(value).over(w)
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn(out, F.when(last, F.col(value) + (F.col(value) - before) / 2).otherwise((F.col(value) + after) / 2))
