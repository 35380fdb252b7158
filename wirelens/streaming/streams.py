"""Streams that Spark's own operators express, and the tables they keep up to date.

Figures that change are kept as one folder per batch; a batch that is tried
again replaces its folder, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import analytics, ranking


def stream_analytics(events: DataFrame) -> DataFrame:
    """Running template figures; write in update mode."""
    return events.groupBy(analytics.report_key().alias("query")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(analytics.duration_us()).alias("total_us"),
        F.max("duration_ms").alias("max_duration_ms"), F.count_if(F.col("error") != "").alias("error_count"),
        F.count_if(F.col("slow")).alias("slow_count"), F.count_if(F.col("n_plus_1")).alias("n_plus_1_count"),
        F.sum("rows_affected").alias("total_rows"), F.sum("response_total_bytes").alias("total_response_bytes"))


def stream_counters(events: DataFrame) -> DataFrame:
    """Running totals; write in complete mode."""
    return analytics.counters(events)


def stream_bursts(events: DataFrame, watermark: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event counts per time window; rows later than the watermark are dropped."""
    timed = events.withColumn("at", F.timestamp_micros("started_us")).withWatermark("at", watermark)
    return timed.groupBy(F.window("at", size, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("error") != "").alias("errors")).select(
        F.unix_micros("w.start").alias("window_start_us"), F.unix_micros("w.end").alias("window_end_us"), "events", "errors")


def stream_sessions(events: DataFrame, watermark: str, gap: str) -> DataFrame:
    """Sessions of a connection: runs of events with no gap of ``gap`` between them."""
    timed = events.withColumn("at", F.timestamp_micros("started_us")).withWatermark("at", watermark)
    return timed.groupBy("connection_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        "connection_id", F.unix_micros("w.start").alias("session_start_us"),
        F.unix_micros("w.end").alias("session_end_us"), "events")


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps each batch in a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upsert_folders(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Sink of an update-mode stream: each batch's folder is the whole table after it.

    Keys of the batch take the place of their old rows, so a reader needs the newest
    folder only and the work of a batch goes by the number of keys, not by history.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            before = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}")
            rows = before.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def top_events_sink(path: str, kind: str, n: int) -> Callable[[DataFrame, int], None]:
    """Keeps the top ``n`` events so far: the list before this batch, and this batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        own = ranking.top_events(batch, kind, n)
        if batch_id > 0:
            own = ranking.top_of(own.unionByName(batch.sparkSession.read.parquet(f"{path}/batch={batch_id - 1}")), kind, n)
        own.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> int:
    """Process what is there and stop; gives the last batch id (-1 if there was none)."""
    query = (
        rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(sink).start()
    )
    query.awaitTermination()
    progress = query.lastProgress
    return -1 if progress is None else int(progress["batchId"])
