"""Selections: predicates by axis with open or closed bounds, index ranges, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def between(c: Column, lo, hi, bounds: str = "cc") -> Column:
    """Closed (c) or open (o) at each end; None is no limit. The form reaches the scan."""
    parts = []
    if lo is not None:
        parts.append(c >= lo if bounds[0] == "c" else c > lo)
    if hi is not None:
        parts.append(c <= hi if bounds[1] == "c" else c < hi)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def selector(**axes: tuple) -> Column:
    """AND of predicates by column: time=(lo, hi), lon=(lo, hi, "co"), or a value for equality."""
    out = F.lit(True)
    for name, limits in axes.items():
        out = out & (between(F.col(name), *limits) if isinstance(limits, tuple) else F.col(name) == limits)
    return out


def index_range(axis: DataFrame, position: str, lo, hi, bounds: str = "cc", neighbours: bool = False) -> DataFrame:
    """first and last + 1 of the cells of a sorted axis within bounds (0-based); with ``neighbours`` one more at each
    end. Nulls if there is none."""
    n = F.row_number().over(W.orderBy(position)) - 1
    numbered = axis.select(position, n.alias("_n"))
    total = F.count(F.lit(1))
    ends = numbered.agg(F.min(F.when(between(F.col(position), lo, hi, bounds), F.col("_n"))).alias("a"), F.max(F.when(between(F.col(position), lo, hi, bounds), F.col("_n"))).alias("b"), total.alias("n"))
    if not neighbours:
        return ends.select(F.col("a").alias("first"), (F.col("b") + 1).alias("last"))
    return ends.select(F.greatest(F.col("a") - 1, F.lit(0)).alias("first"), F.least(F.col("b") + 2, F.col("n")).cast("int").alias("last"))


def mask_box(field: DataFrame, by: list[str], valid: Column) -> DataFrame:
    """Least and greatest index of the valid cells."""
    rows = field.filter(valid)
    aggs = [F.min("j").alias("jmin"), F.max("j").alias("jmax"), F.min("i").alias("imin"), F.max("i").alias("imax")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def merge_masks(df: DataFrame, values: list[str], mode: str = "max") -> DataFrame:
    """All of ``values`` become null where any is (``max``), or where all are (``min``)."""
    masked = reduce((lambda a, b: a | b) if mode == "max" else (lambda a, b: a & b), [F.col(v).isNull() for v in values])
    return df.withColumns({v: F.when(~masked, F.col(v)) for v in values})


def close_to(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """struct<lo, hi, length> of what two segments share, whichever way they run; null if they do not meet."""
    ends = [(F.least(*s), F.greatest(*s)) for s in (a, b)]
    lo, hi = F.greatest(ends[0][0], ends[1][0]), F.least(ends[0][1], ends[1][1])
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi"), (hi - lo).alias("length")))


def thin_by_distance(grid: DataFrame, by: list[str], order: str, x: str, y: str, step: float) -> DataFrame:
    """Rows of each line of a grid of which the way along the line passes a multiple of ``step``; the first always."""
    w = W.partitionBy(*by).orderBy(order)
    rows = grid.withColumn("_d", F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0)))
    rows = rows.withColumn("_k", F.floor(F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0)) / step))
    return rows.withColumn("_b", F.lag("_k").over(w)).filter("_b is null or _k != _b").drop("_d", "_k", "_b")


def squeeze(df: DataFrame, axes: list[str]) -> DataFrame:
    """Without the axes that have one value. One aggregation over all of them decides."""
    ends = df.agg(*[F.min(a).alias(f"{a}_lo") for a in axes], *[F.max(a).alias(f"{a}_hi") for a in axes]).first()
    return df.drop(*[a for a in axes if ends[f"{a}_lo"] == ends[f"{a}_hi"]])


def index_runs(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Runs of consecutive indices: first, last."""
    w = W.partitionBy(*by).orderBy(index)
    runs = df.select(*by, index).distinct().withColumn("_r", F.col(index) - F.row_number().over(w))
    return runs.groupBy(*by, "_r").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_r")


def every_nth(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.filter(F.pmod(F.col(index), F.lit(n)) == 0)


def uv_masks(mask: DataFrame, by: list[str], land: str) -> DataFrame:
    """Land at U and V points of a C grid: of the cell or its neighbour to the right, or above."""
    right, above = F.lead(land).over(W.partitionBy(*by, "j").orderBy("i")), F.lead(land).over(W.partitionBy(*by, "i").orderBy("j"))
    return mask.select(*by, "j", "i", (F.col(land) | F.coalesce(right, F.col(land))).alias("land_u"), (F.col(land) | F.coalesce(above, F.col(land))).alias("land_v"))
