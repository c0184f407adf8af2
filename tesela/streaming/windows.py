"""Structured Streaming: event-time windows, late data, sessions and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.sources.sinks import scratch


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events of a Parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events and value sums per type in tumbling or sliding windows; state of windows older than the watermark is dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of users: bursts of events at most ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def without_repeats(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without redelivered ones, remembered as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the result as a table written in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
