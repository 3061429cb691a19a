"""Queries that run a stream to its end and read what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from halocline.operators import stats
from halocline.operators.cut import shared_folder
from halocline.plans.inputs import r6, table
from halocline.plans.registry import register
from halocline.streaming import accumulate

QUERIES: dict = {}
ORACLE: dict = {}
query = register(QUERIES, ORACLE)


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/halocline/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type, count(value) AS count, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def streamed_statistics(spark, d):
    """Statistics from sums that micro-batches added."""
    schema, root = table(spark, d, "events").schema, _folder(spark, "stream")
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    accumulate.accumulate_to(stream, f"{root}/sums", ["event_type"], "value", None, f"{root}/checkpoint").awaitTermination()
    found = stats.statistics(stats.merge(spark.read.parquet(f"{root}/sums"), ["event_type"]), ["event_type"])
    return found.select("event_type", "count", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min", "max")


@query("SELECT date_trunc('day', ts) AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_daily_means(spark, d):
    """Windows of event time, closed by the watermark or the end of the stream: all of them, as the stream ends."""
    schema, root = table(spark, d, "events").schema, _folder(spark, "windows")
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC"))

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    means = accumulate.window_means(stream, "ts", ["event_type"], "value", "1 day", "1 day")
    means.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{root}/out")
    last = kept.groupBy("start", "event_type").agg(F.max_by(F.struct("mean", "n"), "batch").alias("x"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", r6("x.mean").alias("mean"), "x.n")
