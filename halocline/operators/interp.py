"""Interpolation and remapping along one axis.

Source and target rows are put together and sorted once by ``by`` and position; what is below and above a target comes
from running windows, so nothing is collected and no pair of rows is made. Cell averages join cells that overlap
through coarse cells of the axis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _tagged(src: DataFrame, dst: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    a = src.filter(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x"), F.struct(F.col(x).alias("x"), F.col(value).cast("double").alias("v")).alias("_s"))
    b = dst.filter(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x"), F.lit(None).cast(a.schema["_s"].dataType).alias("_s"))
    return a.unionByName(b)


def interp1d(src: DataFrame, dst: DataFrame, by: list[str], x: str, value: str, method: str = "linear", extrapolate: str = "none", out: str = "value") -> DataFrame:
    """Values of ``src`` at the positions of ``dst`` (by, x), ``linear``, ``nearest`` or ``hermite`` (a cubic through
    the neighbours with centred slopes; the ends' outer neighbours lie on the line of the last two).

    A target on a node has its value; between nodes any of which is null it is null; nearest takes the upper of two
    equally far. Outside the nodes it is null, unless ``extrapolate`` is ``below``, ``above`` or ``both``: then the
    outermost valid value. x is a number.
    """
    order = [F.col("_x"), F.col("_s").isNull()]  # sources first where positions are equal
    nodes = W.partitionBy(*by).orderBy("_x")
    is_source = F.col("_s").isNotNull()
    rows = _tagged(src, dst, by, x, value)
    if method == "hermite":
        # neighbours of neighbours are taken among sources alone, before targets come in between
        only = rows.filter(is_source)
        only = only.withColumn("_s", F.struct("_s.x", "_s.v", F.lag("_s.v").over(nodes).alias("b"), F.lag("_s.x").over(nodes).alias("bx"), F.lead("_s.v").over(nodes).alias("a"), F.lead("_s.x").over(nodes).alias("ax")))
        rest = rows.filter(~is_source).withColumn("_s", F.lit(None).cast(only.schema["_s"].dataType))
        rows = only.unionByName(rest)
    # both look back, one from either end: a frame that reaches ahead to the end would start anew at every row
    down = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy(*by).orderBy(F.col("_x").desc(), F.col("_s").isNull()).rowsBetween(W.unboundedPreceding, 0)
    valid = F.when(F.col("_s.v").isNotNull(), F.col("_s.v"))
    rows = rows.withColumns({
        "_lo": F.last("_s", ignorenulls=True).over(down), "_hi": F.last("_s", ignorenulls=True).over(up),
        "_under": F.last(valid, ignorenulls=True).over(down), "_over": F.last(valid, ignorenulls=True).over(up),
    }).filter(~is_source)
    lo, hi, at = F.col("_lo"), F.col("_hi"), F.col("_x")
    on_low, on_high = lo["x"] == at, hi["x"] == at
    p = (at - lo["x"]) / (hi["x"] - lo["x"])
    if method == "nearest":
        between = F.when(at - lo["x"] < hi["x"] - at, lo["v"]).otherwise(hi["v"])
        between = F.when(lo["v"].isNotNull() & hi["v"].isNotNull(), between)
    elif method == "linear":
        between = lo["v"] + (hi["v"] - lo["v"]) * p
    else:
        before = F.when(lo["bx"].isNull(), 2 * lo["v"] - hi["v"]).otherwise(lo["b"])
        after = F.when(hi["ax"].isNull(), 2 * hi["v"] - lo["v"]).otherwise(hi["a"])
        m0, m1 = (hi["v"] - before) / 2, (after - lo["v"]) / 2
        p2, p3 = p * p, p * p * p
        between = (2 * p3 - 3 * p2 + 1) * lo["v"] + (p3 - 2 * p2 + p) * m0 + (3 * p2 - 2 * p3) * hi["v"] + (p3 - p2) * m1
    result = F.when(on_low, lo["v"]).when(on_high, hi["v"]).otherwise(F.when(lo.isNotNull() & hi.isNotNull(), between))
    if extrapolate in ("below", "both"):
        result = F.coalesce(result, F.when(F.col("_under").isNull(), F.col("_over")))
    if extrapolate in ("above", "both"):
        result = F.coalesce(result, F.when(F.col("_over").isNull(), F.col("_under")))
    return rows.select(*by, F.col("_x").alias(x), result.alias(out))


def at_position(src: DataFrame, by: list[str], x: str, value: str, at: float, out: str = "value") -> DataFrame:
    """``interp1d``'s linear values at one position, the same in all groups, for one row a group of ``by``.

    The nodes next to it are two extremes, so this is an aggregation: no row is sorted, none is added for the target.
    """
    here, v = F.col(x), F.col(value).cast("double")
    lo, hi, at = F.when(here <= at, here), F.when(here >= at, here), F.lit(at)
    nodes = src.groupBy(*by).agg(F.max(lo).alias("_lo"), F.max_by(v, lo).alias("_a"), F.min(hi).alias("_hi"), F.min_by(v, hi).alias("_b"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * ((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return nodes.select(*by, F.when(F.col("_lo") == at, F.col("_a")).when(F.col("_hi") == at, F.col("_b")).otherwise(between).alias(out))


def overlap(src: DataFrame, dst: DataFrame, by: list[str], lo: str, hi: str, coarse: float) -> DataFrame:
    """Pairs of source and target cells that overlap, and by how much: joined on coarse cells of the axis.

    src: by, lo, hi and more; dst: by, d_lo, d_hi and more. coarse: about the width of the larger cells. A pair that
    meets in several coarse cells counts in the one where the overlap begins.
    """
    begin, end = F.floor(F.col(lo) / coarse), F.ceil(F.col(hi) / coarse) - 1
    a = src.withColumn("_c", F.explode(F.sequence(begin.cast("long"), F.greatest(begin, end).cast("long"))))
    begin, end = F.floor(F.col("d_lo") / coarse), F.ceil(F.col("d_hi") / coarse) - 1
    b = dst.withColumn("_c", F.explode(F.sequence(begin.cast("long"), F.greatest(begin, end).cast("long"))))
    first = F.greatest(F.col(lo), F.col("d_lo"))
    width = F.least(F.col(hi), F.col("d_hi")) - first
    joined = a.join(b, [*by, "_c"]).withColumn("overlap", width)
    return joined.filter((F.col("overlap") > 0) & (F.floor(first / coarse) == F.col("_c"))).drop("_c")


def cell_average(src: DataFrame, dst: DataFrame, by: list[str], keys: list[str], value: str, coarse: float, lo: str = "lo", hi: str = "hi", conserve: bool = False, out: str = "value") -> DataFrame:
    """Means of ``value`` over target cells (by, keys, d_lo, d_hi), by length of overlap; ``conserve`` shares each
    source cell's value out by the part of the cell. Null cells do not count; targets without overlap are left out."""
    pairs = overlap(src.filter(F.col(value).isNotNull()), dst, by, lo, hi, coarse)
    if conserve:
        result = F.sum(F.col(value) * F.col("overlap") / (F.col(hi) - F.col(lo)))
    else:
        result = F.sum(F.col(value) * F.col("overlap")) / F.sum("overlap")
    return pairs.groupBy(*by, *keys).agg(result.alias(out))


def cell_error(src: DataFrame, dst: DataFrame, by: list[str], keys: list[str], x: str, value: str, error: str, lag_error: float, coarse: float) -> DataFrame:
    """Means over target cells weighted by 1 / (error^2 + lag), lag = lag_error * distance to the cell's centre x_out
    (lag_error^2 if it is negative), and the error 1 / sqrt(sum of weights)."""
    scale = lag_error if lag_error >= 0 else lag_error**2
    points = src.filter(F.col(value).isNotNull()).withColumn("_c", F.floor(F.col(x) / coarse).cast("long"))
    begin, end = F.floor(F.col("d_lo") / coarse), F.floor(F.col("d_hi") / coarse)
    cells = dst.withColumn("_c", F.explode(F.sequence(begin.cast("long"), end.cast("long"))))
    pairs = points.join(cells, [*by, "_c"]).filter((F.col(x) >= F.col("d_lo")) & (F.col(x) < F.col("d_hi")))
    w = 1 / (F.col(error) * F.col(error) + scale * F.abs(F.col(x) - F.col("x_out")))
    return pairs.groupBy(*by, *keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"), (1 / F.sqrt(F.sum(w))).alias("error"))


def climatology(clim: DataFrame, dst: DataFrame, by: list[str], month: str, ts: str, value: str, day: int = 15, method: str = "linear") -> DataFrame:
    """A 12-month climatology at given times: each month's value stands on its ``day``, over the turn of the year too."""
    # a time lies between the middles of this month and of the one before or after
    y, m = F.year(ts), F.month(ts)
    mid = F.make_timestamp_ntz(y, m, F.lit(day), F.lit(0), F.lit(0), F.lit(0))
    late = F.col(ts) >= mid
    first = F.when(late, mid).otherwise(F.timestamp_add("MONTH", F.lit(-1), mid))
    last = F.timestamp_add("MONTH", F.lit(1), first)
    p = F.timestamp_diff("MICROSECOND", first, F.col(ts)) / F.timestamp_diff("MICROSECOND", first, last)
    rows = dst.withColumns({"_m0": F.month(first), "_m1": F.month(last), "_p": p})
    if method == "nearest":
        rows = rows.withColumn("_p", F.when(F.col("_p") < 0.5, 0.0).otherwise(1.0))
    a = clim.select(*by, F.col(month).alias("_m0"), F.col(value).alias("_v0"))
    b = clim.select(*by, F.col(month).alias("_m1"), F.col(value).alias("_v1"))
    joined = rows.join(a, [*by, "_m0"], "left").join(b, [*by, "_m1"], "left")
    return joined.withColumn("value", F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_p")).drop("_m0", "_m1", "_p", "_v0", "_v1")
