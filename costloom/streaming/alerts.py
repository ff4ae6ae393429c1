"""Extension: tumbling windows over an event stream with a watermark, and alerts beyond a calibrated band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """day, event_type, n, total; a window is final once the watermark has passed it, later rows are dropped."""
    t = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return t.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def start_alerts(windows: DataFrame, base: DataFrame, band: float, sink, checkpoint: str) -> StreamingQuery:
    """Windows whose total is more than band percent off the type's base (event_type, base) go to sink(df, epoch)."""

    def each(df: DataFrame, epoch: int) -> None:
        joined = df.join(F.broadcast(base), "event_type").withColumn("change_pct", (F.col("total") / F.nullif(F.col("base"), F.lit(0.0)) - 1) * 100)
        sink(joined.filter(F.abs("change_pct") > band), epoch)

    return windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
