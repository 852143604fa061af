"""Event-time windows, deduplication and liveness over streams (the same expressions run over batches)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, width: str = "5 minutes", slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Events and error share by type and sliding window."""
    w = F.window(F.col("ts").cast("timestamp"), width, slide)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("start"), "event_type", "n", "errors")


def sessions(events: DataFrame, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """A row for each stretch of a user's events without a gap: the user is dead between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(events: DataFrame, key: str, ttl: str = "30 days") -> DataFrame:
    """First event of each key within the time to live."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])


def replayed(frame: DataFrame, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream puts out until its source is read to the end."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)
