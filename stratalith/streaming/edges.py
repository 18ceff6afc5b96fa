"""Edge counts of a stream of events by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def windowed_edges(stream: DataFrame, src: str, dst: str, value: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, src, dst, cnt, total by tumbling window; state of a window goes once the watermark has passed it."""
    rows = stream.withWatermark(time, late).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    out = rows.groupBy(F.window(time, window).alias("w"), F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), "src", "dst", "cnt", "total")


def drained(spark: SparkSession, result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into Parquet, and read that. Every window closes: the source must end with a later event, or the mode be complete."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)
