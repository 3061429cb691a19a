"""Tidal series: filters of hourly sea level, anomalies, crossings, high and low water."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halocline.operators import windows


def godin() -> list[float]:
    """Running means of 24, 24 and 25 hours, one after the other: 71 weights that sum to 1."""
    def convolve(a: list[float], b: list[float]) -> list[float]:
        out = [0.0] * (len(a) + len(b) - 1)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i + j] += x * y
        return out

    box = lambda n: [1.0 / n] * n
    return convolve(convolve(box(24), box(24)), box(25))


# Half of Demerliac's weights, from the centre out.
DEMERLIAC = [
    768, 766, 762, 752, 738, 726, 704, 678, 658, 624, 586, 558, 512, 465, 435, 392, 351, 325, 288, 253, 231, 200, 171, 153, 128, 105, 91, 72, 55, 45, 32, 21, 15, 8, 3, 1,
]


def demerliac() -> list[float]:
    total = DEMERLIAC[0] + 2 * sum(DEMERLIAC[1:])
    return [c / total for c in DEMERLIAC[:0:-1] + DEMERLIAC]


def tide_filter(df: DataFrame, by: list[str], ts: str, value: str, weights: list[float], out: str = "filtered") -> DataFrame:
    """The series without tide, on an hourly axis without holes; null where the window is not whole.

    A frame of rows holds the window, so that its values are weighted in one pass, not one expression a weight.
    """
    half = len(weights) // 2
    frame = W.partitionBy(*by).orderBy(ts).rowsBetween(-half, half)
    held = F.collect_list(value).over(frame)  # nulls are left out, and so show by the length
    kernel = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate(F.zip_with(held, kernel, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn(out, F.when(F.size(held) == len(weights), total))


def hourly_axis(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    return windows.regular(df, by, ts, "1 hour")


def tide(df: DataFrame, by: list[str], ts: str, value: str, weights: list[float]) -> DataFrame:
    """Adds ``surge``, the filtered series, and ``tide``, what the filter took."""
    filtered = tide_filter(df, by, ts, value, weights, "surge")
    return filtered.withColumn("tide", F.col(value) - F.col("surge"))


def high_and_low_water(df: DataFrame, by: list[str], ts: str, anomaly: str) -> DataFrame:
    """Times and heights of high (sign 1) and low (-1) water."""
    return windows.extrema(df, by, ts, anomaly)
