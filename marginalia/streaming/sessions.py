"""Sessions as streams: fan-out of requests, running progress, last status, windows of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.requests import fan_out


def tasks(requests: DataFrame, size: int = 2) -> DataFrame:
    """A stream of requests to one of tasks; stateless."""
    return fan_out(requests, size=size)


def running_progress(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """session_id, total, last_status, seen of a stream (session_id, seq, n, status, ts), for update or complete mode."""
    return events.withWatermark("ts", delay).groupBy("session_id").agg(
        F.sum("n").alias("total"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("last_status"), F.max("ts").alias("seen"))


def activity(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", by: str = "session_id") -> DataFrame:
    """Sessions of activity: start, end, number and sum of events that are at most gap apart, for append mode."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(by, w).agg(F.count("*").alias("n_events"), F.sum("n").alias("total")).select(by, "session_window.start", "session_window.end", "n_events", "total")


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", by: str = "status") -> DataFrame:
    """Events in windows of fixed width."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n_events"), F.sum("n").alias("total")).select(F.col("window.start").alias("start"), by, "n_events", "total")


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None):
    """Starts a query that writes Parquet, or tables by batch for update mode; available data only unless every is given."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
