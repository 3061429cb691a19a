"""Statistics over streams: windows with late data, and an accumulator that batches add to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halocline.operators import stats


def window_means(stream: DataFrame, ts: str, by: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by group and window of event time; windows close, and leave the state, when the watermark passes them."""
    windows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    means = windows.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "mean", "n")


def accumulate_to(stream: DataFrame, path: str, by: list[str], x: str, y: str | None, checkpoint: str) -> StreamingQuery:
    """Writes the sums of every micro-batch as its own partition of ``path``: a batch that is run again replaces its own
    sums, so each row counts once. ``stats.merge`` over the table gives the totals at any time."""

    def add(batch: DataFrame, number: int) -> None:
        stats.accumulate(batch, by, x, y).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_of(stream: DataFrame, ts: str, by: list[str], batch: str, value: str, late: str) -> DataFrame:
    """The latest batch's value of each time and group, kept while the watermark allows for it."""
    latest = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 second"), *by)
    return latest.agg(F.max_by(value, batch).alias(value), F.max(batch).alias(batch)).select(F.col("window.start").alias(ts), *by, value, batch)
