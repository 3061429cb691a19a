"""Mergeable statistics of one or two variables, and what else sums and ranks give.

A statistic is made of moments about the mean, which do not cancel where values are large: ``accumulate`` groups them,
``merge`` joins those of several batches, ``statistics`` turns them into means, deviations and the like. Every step is
a grouped aggregation, partial on the map side.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.operators.cut import Steps


def mask_nan(c: Column) -> Column:
    """Null where a value is not a number."""
    return F.when(~F.isnan(c), c)


MOMENTS = ["m2_x", "m2_y", "c_xy"]  # sums of products of deviations from the means


def accumulate(df: DataFrame, by: list[str], x: str, y: str | None = None, edges: list[float] | None = None, around: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Moments by ``by``. With ``y`` only rows where both are valid count. edges: bins [e, next e) of x; others are left out.

    ``around``: rough means of x and y. Values are taken from there, so that products of two variables that are far from
    nought but vary little keep their digits.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double") if y else F.lit(None).cast("double")
    valid = a.isNotNull() & ~F.isnan(a) & ((b.isNotNull() & ~F.isnan(b)) if y else F.lit(True))
    a, b = F.when(valid, a), F.when(valid, b)
    u, v = (c - F.lit(float(m)) if m else c for c, m in zip((a, b), around, strict=True))
    aggs = [
        F.count(F.lit(1)).alias("size"), F.count(a).alias("count"), (F.avg(u) + around[0]).alias("mean_x"), (F.avg(v) + around[1]).alias("mean_y"), (F.var_pop(u) * F.count(u)).alias("m2_x"),
        (F.var_pop(v) * F.count(v)).alias("m2_y"), (F.covar_pop(u, v) * F.count(v)).alias("c_xy"), F.avg(b - a).alias("mean_d"), F.sum((b - a) * (b - a)).alias("sum_dd"),
        F.min(a).alias("min_x"), F.max(a).alias("max_x"), F.min(b).alias("min_y"), F.max(b).alias("max_y"),
    ]
    if edges:
        bins = [F.count(F.when((a >= lo) & (a < hi), 1)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        aggs.append(F.array(*bins).alias("hist"))
    return df.groupBy(*by).agg(*aggs)


def merge(partials: DataFrame, by: list[str], bins: int = 0) -> DataFrame:
    """Joins the moments of several batches, a row a batch and group; ``bins``: of the histogram, if there is one.

    Means are joined by how far they are from one of them, so that large ones keep their digits."""
    n, group = F.col("count"), W.partitionBy(*by)
    both = partials.withColumns({f"_l{c}": F.min(c).over(group) for c in ("mean_x", "mean_y")})
    mean = lambda c: F.col(f"_l{c}") + F.sum(n * (F.col(c) - F.col(f"_l{c}"))).over(group) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), n)).over(group), F.lit(0))
    both = both.withColumns({"_mx": mean("mean_x"), "_my": mean("mean_y")})
    dx, dy = F.col("mean_x") - F.col("_mx"), F.col("mean_y") - F.col("_my")
    aggs = [
        F.sum("size").alias("size"), F.sum("count").alias("count"), F.max("_mx").alias("mean_x"), F.max("_my").alias("mean_y"), F.sum(F.col("m2_x") + n * dx * dx).alias("m2_x"),
        F.sum(F.col("m2_y") + n * dy * dy).alias("m2_y"), F.sum(F.col("c_xy") + n * dx * dy).alias("c_xy"),
        (F.sum(n * F.col("mean_d")) / F.nullif(F.sum(F.when(F.col("mean_d").isNotNull(), n)), F.lit(0))).alias("mean_d"), F.sum("sum_dd").alias("sum_dd"),
    ]
    aggs += [F.min(c).alias(c) for c in ("min_x", "min_y")] + [F.max(c).alias(c) for c in ("max_x", "max_y")]
    if "hist" in partials.columns:
        aggs.append(F.array(*[F.sum(F.get("hist", F.lit(i))) for i in range(bins)]).alias("hist"))
    return both.groupBy(*by).agg(*aggs)


def statistics(partials: DataFrame, by: list[str]) -> DataFrame:
    """avail, count, mean, std, min, max of x (and of y as *_y), bias = y - x, rms, crms, corr; deviations divide by n."""
    n = F.nullif(F.col("count"), F.lit(0))
    vx, vy, cov = (F.col(c) / n for c in MOMENTS)
    zero = F.lit(0.0)
    out = {
        "avail": F.col("count") / F.col("size"), "count": F.col("count"), "mean": F.col("mean_x"), "std": F.sqrt(vx), "min": F.col("min_x"), "max": F.col("max_x"), "mean_y": F.col("mean_y"), "std_y": F.sqrt(vy),
        "bias": F.col("mean_d"), "rms": F.sqrt(F.col("sum_dd") / n), "crms": F.sqrt(F.greatest(vx + vy - 2 * cov, zero)), "corr": cov / F.nullif(F.sqrt(vx * vy), zero),
    }
    hist = ["hist"] if "hist" in partials.columns else []
    return partials.select(*by, *[c.alias(k) for k, c in out.items()], *hist)


def ensemble_rank(members: DataFrame, by: list[str], member: str, obs: str) -> DataFrame:
    """How many members are below the observation, by cell: 0 to the number of members."""
    valid = F.col(member).isNotNull() & F.col(obs).isNotNull()
    return members.filter(valid).groupBy(*by).agg(F.sum((F.col(member) < F.col(obs)).cast("long")).alias("rank"), F.count(F.lit(1)).alias("members"))


def rank_histogram(ranks: DataFrame, rank: str, members: int) -> DataFrame:
    """How often each rank from 0 to ``members`` stands: rank, n."""
    every = ranks.sparkSession.range(members + 1).select(F.col("id").alias(rank))
    counted = ranks.groupBy(F.col(rank).cast("long").alias(rank)).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, rank, "left").select(rank, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def not_recovered(members: DataFrame, by: list[str], member: str, obs: str, centred: bool = False) -> DataFrame:
    """By cell the least bias of an ensemble that is all above or all below the observation (``nrz``), null where some
    members are on either side, and the rank; ``centred``: after the mean bias is taken off."""
    bias = members.filter(F.col(member).isNotNull() & F.col(obs).isNotNull()).withColumn("_b", F.col(member) - F.col(obs))
    if centred:
        mean = bias.groupBy(*by).agg(F.avg("_b").alias("_m"))
        bias = bias.join(mean, by).withColumn("_b", F.col("_b") - F.col("_m"))
    ends = bias.groupBy(*by).agg(F.min("_b").alias("lo"), F.max("_b").alias("hi"), F.sum((F.col("_b") < 0).cast("long")).alias("rank"))
    return ends.select(*by, "rank", F.when(F.col("hi") < 0, F.col("hi")).when(F.col("lo") > 0, F.col("lo")).alias("nrz"))


def quantile_range(df: DataFrame, by: list[str], value: str, percent: float = 5.0, accuracy: int | None = None) -> DataFrame:
    """Quantiles ``percent`` from either end, with linear interpolation: exact ones, which keep the distinct values of a
    group in memory, or with an ``accuracy`` values whose ranks are at most 1 / accuracy of the rows off."""
    at = F.array(F.lit(percent / 100), F.lit(1 - percent / 100))
    q = F.percentile(F.col(value), at) if accuracy is None else F.percentile_approx(F.col(value), at, accuracy)
    return df.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def trend(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Slope and intercept of the least-squares line of ``value`` over the number ``t``."""
    y, x = F.col(value), F.col(t)
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def detrend(df: DataFrame, by: list[str], t: str, value: str, out: str = "detrended") -> DataFrame:
    line = trend(df, by, t, value)
    joined = df.join(line, by) if by else df.crossJoin(F.broadcast(line))  # a single row
    return joined.withColumn(out, F.col(value) - (F.col("slope") * F.col(t) + F.col("intercept"))).drop("slope", "intercept")


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """Null where there is no value of weight."""
    w = F.when(F.col(value).isNotNull(), weight)
    return df.groupBy(*by).agg((F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("mean"))


def systematic_bias(df: DataFrame, by: list[str], model: str, obs: str) -> DataFrame:
    """1 where the model is below every observation, -1 where it is above every one, else 0."""
    pairs = df.filter(F.col(model).isNotNull() & F.col(obs).isNotNull())
    signs = pairs.groupBy(*by).agg(F.sum(F.signum(F.col(obs) - F.col(model))).alias("s"), F.count(F.lit(1)).alias("n"))
    return signs.select(*by, F.when(F.abs("s") == F.col("n"), F.signum("s")).otherwise(0.0).cast("int").alias("systematic"))


def bias_extrema(df: DataFrame, by: list[str], model: str, obs: str) -> DataFrame:
    """The differences obs - model that are least and greatest in size."""
    d = F.col(obs) - F.col(model)
    return df.filter(d.isNotNull()).groupBy(*by).agg(F.min_by(d, F.abs(d)).alias("least"), F.max_by(d, F.abs(d)).alias("greatest"))


def coverage(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Valid values, and their share in percent."""
    return df.groupBy(*by).agg(F.count(value).alias("valid"), (100.0 * F.count(value) / F.count(F.lit(1))).alias("percent"))


def dominant_direction(df: DataFrame, by: list[str], direction: str, amplitude: str | None = None, width: float = 22.5) -> DataFrame:
    """Centre of the sector of ``width`` degrees with most directions, or most amplitude; of equal ones the lowest."""
    sector = F.pmod(F.floor((F.col(direction) + width / 2) / width), F.lit(round(360 / width))).cast("int")
    weight = F.sum(amplitude) if amplitude else F.count(F.lit(1)).cast("double")
    counted = df.filter(F.col(direction).isNotNull()).groupBy(*by, sector.alias("sector")).agg(weight.alias("w"))
    best = counted.groupBy(*by).agg(F.max_by("sector", F.struct(F.col("w"), -F.col("sector"))).alias("sector"))
    return best.select(*by, (F.col("sector") * width).alias("direction"))


def anomaly(df: DataFrame, by: list[str], value: str, out: str = "anomaly") -> DataFrame:
    """Departure from the mean, the mean joined back rather than windowed, so that one group may be large."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    joined = df.join(mean, by) if by else df.crossJoin(F.broadcast(mean))  # a single row
    return joined.withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def arctan_normal(df: DataFrame, by: list[str], value: str, stretch: float = 1.0, out: str = "normal") -> DataFrame:
    """2/pi arctan(stretch * value / std); the deviation is joined back, so that one group may be large."""
    spread = df.groupBy(*by).agg(F.stddev_pop(value).alias("_std"))
    joined = df.join(spread, by) if by else df.crossJoin(F.broadcast(spread))  # a single row
    return joined.withColumn(out, F.atan(stretch * F.col(value) / F.nullif(F.col("_std"), F.lit(0.0))) * F.lit(2 / 3.141592653589793)).drop("_std")


def quantiles(counted: DataFrame, value: str, n: str, shares: list[float], slices: int, steps: Steps) -> DataFrame:
    """share, value: of values, each of which counts ``n`` times, the smallest that with those below makes up a share of
    all, exactly. ``counted`` is a written table with a row a value.

    Counts of ``slices`` equal parts of the range tell in which of them a share is reached; only the values there are sorted.
    """
    v = F.col(value).cast("double")
    low, high, total = counted.agg(F.min(v), F.max(v), F.sum(n)).first()
    if not total:
        return counted.select(F.lit(0.0).alias("share"), v.alias("value")).limit(0)
    part = F.least(F.floor((v - low) / ((high - low) / slices)), F.lit(slices - 1)).cast("int") if high > low else F.lit(0)
    rows = counted.select(v.alias("value"), F.col(n).alias("n"), part.alias("part"))
    upto = F.sum("n").over(W.orderBy("part"))  # as many rows as slices
    parts = steps.write(rows.groupBy("part").agg(F.sum("n").alias("n")).withColumn("below", upto - F.col("n")))
    asked = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(max(1, math.ceil(s * total - 1e-9))).cast("long").alias("rank")) for s in shares])).alias("a")
    asked = parts.select("part", "n", "below", asked).filter("a.rank > below and a.rank <= below + n").select("part", "below", "a.share", "a.rank")
    here = rows.join(F.broadcast(asked.select("part", "below").distinct()), "part")  # no more rows than shares
    here = here.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy("part").orderBy("value"))).select("part", "value", "upto")
    return here.join(F.broadcast(asked), "part").filter("upto >= rank").groupBy("share").agg(F.min("value").alias("value"))


def correlation_probability(df: DataFrame, r: str, n: str, datasets: int = 2, out: str = "probability") -> DataFrame:
    """Percent of confidence that a correlation of ``n`` values differs from none: Student's t with n - 2 - datasets
    degrees of freedom, its two-sided integral taken over the angle arctan(t / sqrt(dof)) by Gauss's rule of 64 places.

    The angle is arcsin |r|, and the density is proportional to cos(a)^(dof - 1): beyond 9 / sqrt(dof - 1) it is less than
    1e-17 of that at 0, and left out, so that the places stand as close for many values as for few.
    """
    dof = F.col(n) - 2 - datasets
    at, weight = np.polynomial.legendre.leggauss(64)
    places = F.array(*[F.struct(F.lit(float(a + 1) / 2).alias("a"), F.lit(float(w) / 2).alias("w")) for a, w in zip(at, weight, strict=True)])
    wide = F.when(dof > 1, 9 / F.sqrt(dof - 1))

    def area(to: Column) -> Column:
        end = F.least(to, wide)  # of one degree of freedom there is no bound, and a null is passed over
        return end * F.aggregate(places, F.lit(0.0), lambda acc, p: acc + p["w"] * F.pow(F.cos(end * p["a"]), dof - 1))

    return df.withColumn(out, F.when(dof > 0, 100 * F.least(F.lit(1.0), area(F.asin(F.abs(F.col(r)))) / area(F.lit(1.5707963267948966)))))
