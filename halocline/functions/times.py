"""Dates and times as column expressions. Times are timestamps without zone; intervals are [lo, hi) unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: microseconds in a unit
UNITS = {"us": 1, "ms": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
EPOCHS = {"cnes": "1950-01-01", "nasa": "1958-01-01", "unix": "1970-01-01", "matplotlib": "0001-01-01"}


def relative(ts: Column, unit: str = "day", epoch: str = "1950-01-01") -> Column:
    """Units since an epoch, as a double."""
    return F.timestamp_diff("MICROSECOND", F.lit(epoch).cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / float(UNITS[unit])


def change_units(value: Column, unit: str, epoch: str, new_unit: str, new_epoch: str) -> Column:
    """Relative times in another unit and from another epoch."""
    shift = relative(F.lit(epoch).cast("timestamp_ntz"), new_unit, new_epoch)
    return value * (UNITS[unit] / UNITS[new_unit]) + shift


def julian_day(ts: Column, mode: str = "cnes") -> Column:
    return relative(ts, "day", EPOCHS[mode])


def round_date(ts: Column, unit: str, step: int = 1, mode: str = "round") -> Column:
    """To a multiple of ``step`` units, counted within the next larger one (months in the year, hours in the day, ...).

    ``floor``, ``ceil``, or ``round`` to the nearer; of equal distances to the later.
    """
    ts = ts.cast("timestamp_ntz")
    base = F.date_trunc(unit, ts).cast("timestamp_ntz")
    larger = {"second": "minute", "minute": "hour", "hour": "day", "day": "month", "month": "year", "year": None}[unit]
    if larger is None:
        n = F.year(ts)
    else:
        count = {"second": F.second(ts), "minute": F.minute(ts), "hour": F.hour(ts), "day": F.dayofmonth(ts) - 1, "month": F.month(ts) - 1}
        n = count[unit]
    low = F.timestamp_add(unit.upper(), -(n % step), base)
    if mode == "floor":
        return low
    high = F.timestamp_add(unit.upper(), F.lit(step), low)
    if mode == "ceil":
        return F.when(ts == low, low).otherwise(high)
    return F.when(F.timestamp_diff("MICROSECOND", low, ts) < F.timestamp_diff("MICROSECOND", ts, high), low).otherwise(high)


def midnight(ts: Column) -> Column:
    return round_date(ts, "day")


def add_time(ts: Column, n: Column | int, unit: str) -> Column:
    """Months and years keep the day, or take the month's last where there is none such."""
    return F.timestamp_add(unit.upper(), F.lit(n) if isinstance(n, int) else n, ts)


def in_range(ts: Column, lo: Column, hi: Column, bounds: str = "co") -> Column:
    """-1 before, 0 within, 1 after an interval that is closed (c) or open (o) at each end."""
    before = ts < lo if bounds[0] == "c" else ts <= lo
    after = ts > hi if bounds[1] == "c" else ts >= hi
    return F.when(before, -1).when(after, 1).otherwise(0)


def within(ts: Column, lo: Column, hi: Column, bounds: str = "co") -> Column:
    """The predicate of in_range() == 0, in a form that reaches the scan."""
    return (ts >= lo if bounds[0] == "c" else ts > lo) & (ts <= hi if bounds[1] == "c" else ts < hi)


def intersect(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """struct<lo, hi> of two half-open intervals; null if they do not meet."""
    lo, hi = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def union(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """struct<lo, hi>: the smallest interval that holds both."""
    return F.struct(F.least(a[0], b[0]).alias("lo"), F.greatest(a[1], b[1]).alias("hi"))


def split(lo: Column, hi: Column, n: int, unit: str) -> Column:
    """array<struct<lo, hi>>: consecutive intervals of ``n`` units from ``lo``; the last ends at ``hi``."""
    step = F.expr(f"interval {n} {unit}")
    starts = F.filter(F.sequence(lo, hi, step), lambda s: s < hi)
    return F.transform(starts, lambda s: F.struct(s.alias("lo"), F.least(F.timestamp_add(unit.upper(), F.lit(n), s), hi).alias("hi")))


#: strftime tokens, and what they are in Spark's patterns
TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%b": "MMM"}


def pattern(strftime: str) -> str:
    for token, there in TOKENS.items():
        strftime = strftime.replace(token, there)
    return strftime


def to_text(ts: Column, strftime: str) -> Column:
    return F.date_format(ts, pattern(strftime))


def from_text(s: Column, strftime: str) -> Column:
    """Null if the text does not fit."""
    return F.try_to_timestamp(s, F.lit(pattern(strftime))).cast("timestamp_ntz")


def zone_to_zone(ts: Column, old: str, new: str) -> Column:
    return F.convert_timezone(F.lit(old), F.lit(new), ts)


def add_margin(lo: Column, hi: Column, n: int, unit: str) -> Column:
    """struct<lo, hi>, wider by ``n`` units at either end."""
    return F.struct(add_time(lo, -n, unit).alias("lo"), add_time(hi, n, unit).alias("hi"))


def round_interval(lo: Column, hi: Column, unit: str, step: int = 1, mode: str = "inner") -> Column:
    """struct<lo, hi>: the largest interval of whole steps within (``inner``), or the smallest around (``outer``)."""
    up, down = ("ceil", "floor") if mode == "inner" else ("floor", "ceil")
    return F.struct(round_date(lo, unit, step, up).alias("lo"), round_date(hi, unit, step, down).alias("hi"))


def linear_dates(lo: Column, hi: Column, n: int) -> Column:
    """array of ``n`` times from ``lo`` to ``hi``, evenly spaced, to the microsecond; of one the first."""
    span = F.timestamp_diff("MICROSECOND", lo, hi)
    parts = max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.timestamp_add("MICROSECOND", F.round(k * span / parts).cast("long"), lo))


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts)


#: Units that ``smart_split`` tries, from coarse to fine.
SPLITS = ["year", "quarter", "month", "third of a month", "day"]


def split_starts(ts: Column) -> Column:
    """array<struct<k, start>>: where the interval that holds a time begins, for each of SPLITS."""
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    tenth = F.least(F.floor((F.dayofmonth(ts) - 1) / 10), F.lit(2)) * 10
    third = F.timestamp_add("DAY", tenth.cast("int"), F.date_trunc("month", ts).cast("timestamp_ntz"))
    starts = [F.date_trunc(u, ts).cast("timestamp_ntz") for u in ("year", "quarter", "month")] + [third, day]
    return F.array(*[F.struct(F.lit(k).alias("k"), s.alias("start")) for k, s in enumerate(starts)])


def smart_split(df: DataFrame, ts: str, most: int) -> DataFrame:
    """start, n: the coarsest of SPLITS whose intervals all hold less than ``most`` rows, or days. All are counted in one pass."""
    counted = df.select(F.explode(split_starts(F.col(ts))).alias("s")).groupBy("s.k", "s.start").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("k").agg(F.max("n").alias("m"))
    chosen = largest.agg(F.coalesce(F.min(F.when(F.col("m") < most, F.col("k"))), F.lit(len(SPLITS) - 1)).alias("best"))
    return counted.crossJoin(F.broadcast(chosen)).filter("k = best").select("start", "n")  # a single row
