"""Timeline rows, time bins, grouped lists, concurrency and bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from . import blocks
from .transactions import end_us, per_block, tx_groups, tx_summary


def _or_dash(value: Column) -> Column:
    return F.when(value != "", value).otherwise("-")


def query_timeline(events: DataFrame) -> DataFrame:
    """One row per statement; transaction control is left out."""
    return events.where(~F.col("operation").isin(*text.TX_CONTROL)).select(
        F.lit("event").alias("kind"),
        F.when(F.col("query") != "", F.col("query")).otherwise(F.col("operation")).alias("label"),
        "started_us", "duration_ms",
        F.format_string(
            "seq=%d op=%s conn=%s tx=%s dur=%.2fms rows=%d status=%s", "sequence", "operation", "connection_id",
            _or_dash(F.col("tx_id")), "duration_ms", "rows_affected", text.event_status()).alias("summary"),
        "tx_id", (F.col("error") != "").alias("error"), "slow", "n_plus_1", "sequence",
    )


def tx_timeline(events: DataFrame) -> DataFrame:
    """One row per transaction, by its first event."""
    return tx_summary(events).select(
        F.lit("tx").alias("kind"),
        F.format_string("tx %s (%d stmt)", F.left("tx_id", F.lit(8)), "event_count").alias("label"),
        "started_us", "duration_ms",
        F.format_string(
            "tx=%s conn=%s events=%d rows=%d errors=%d slow=%d n+1=%d preview=%s", "tx_id", "connection_id",
            "event_count", "rows_affected", "error_count", "slow_count", "n_plus_1_count", "query_preview").alias("summary"),
        "tx_id", (F.col("error_count") > 0).alias("error"), (F.col("slow_count") > 0).alias("slow"),
        (F.col("n_plus_1_count") > 0).alias("n_plus_1"), F.col("first_sequence").alias("sequence"),
    ).orderBy("sequence")


def extent(rows: DataFrame) -> Column:
    """First start, last end and span (at least 1 ms) of all rows, as one scalar."""
    ends = rows.agg(F.min("started_us").alias("low"), F.max(end_us()).alias("high"))
    return ends.select(F.struct(
        "low", "high", F.greatest(F.col("high") - F.col("low"), F.lit(1000)).alias("span"))).scalar()


def with_extent(rows: DataFrame) -> DataFrame:
    """Attach the overall extent to every row."""
    return rows.withColumn("_e", extent(rows)).withColumns({
        "min_us": F.col("_e.low"), "max_us": F.col("_e.high"), "span_us": F.col("_e.span")}).drop("_e")


def place_on_bins(rows: DataFrame, width: int) -> DataFrame:
    """Start and end bin of each row on a chart of ``width`` equal bins."""
    share = (F.col("started_us") - F.col("min_us")) / F.col("span_us").cast("double")
    length = F.col("duration_ms") * 1000.0 / F.col("span_us").cast("double") * width
    start = F.floor(share * max(width - 1, 1))
    taken = F.greatest(F.lit(1), F.ceil(length))
    return with_extent(rows).withColumn("bin_start", start).withColumn(
        "bin_end", F.greatest(F.col("bin_start") + 1, F.least(F.lit(width), F.col("bin_start") + taken)))


def time_bins(rows: DataFrame, width: int) -> DataFrame:
    """Rows active in each bin.

    Each row gives one step up and one step down; the sums per bin are at most
    ``width + 1`` rows, and only those are run over.
    """
    steps = place_on_bins(rows, width).select(F.explode(F.array(
        F.struct(F.col("bin_start").alias("bin"), F.lit(1).alias("step")),
        F.struct(F.col("bin_end").alias("bin"), F.lit(-1).alias("step")),
    )).alias("s")).groupBy("s.bin").agg(F.sum("s.step").alias("step"))
    every = steps.sparkSession.range(width).select(F.col("id").alias("bin"))
    active = every.join(steps, "bin", "left").select(
        "bin", F.sum(F.coalesce("step", F.lit(0))).over(Window.orderBy("bin")).alias("active"))
    return active


def grouped_list(events: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Events by sequence, each transaction gathered under a header at its first event."""
    first = tx_groups(events).withColumnRenamed("first_sequence", "group_key")
    shown = events.select("sequence", "tx_id", "query", "duration_ms")
    inside = F.coalesce(F.col("tx_id") != "", F.lit(False))
    # Only events of a transaction have a header to look up; the others stay where they are.
    found = blocks.with_block(shown.where(inside), "sequence", block_rows).join(
        per_block(events, first, block_rows), ["tx_id", blocks.BLOCK], "left").drop(blocks.BLOCK)
    rows = found.unionByName(shown.where(~inside), allowMissingColumns=True).select(
        F.lit("event").alias("kind"), F.coalesce("group_key", "sequence").alias("group_key"), "sequence", "tx_id",
        text.compact_query(F.col("query"), 120).alias("query"), "duration_ms", F.lit(1).cast("bigint").alias("event_count"),
    )
    headers = tx_summary(events).select(
        F.lit("tx").alias("kind"), F.col("first_sequence").alias("group_key"), F.col("first_sequence").alias("sequence"),
        "tx_id", F.col("query_preview").alias("query"), "duration_ms", "event_count")
    return headers.unionByName(rows).orderBy("group_key", F.col("kind") == "event", "sequence")


def ranked(rows: DataFrame, order: Sequence[str | Column], limit: int) -> DataFrame:
    """The first ``limit`` rows with their rank number."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def concurrency(events: DataFrame, by: str = "connection_id", block_us: int = 60_000_000) -> DataFrame:
    """Most rows active at one moment, per key.

    A row counts from its start to its end, both included. Steps at the same
    moment are summed first; each block of time is folded to its sum and its
    highest point, which is all the next block needs to know.
    """
    steps = events.select(by, F.explode(F.array(
        F.struct(F.col("started_us").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
        F.struct(end_us().alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step")),
    )).alias("s")).groupBy(by, "s.at", "s.kind").agg(F.sum("s.step").alias("step"))
    local = blocks.with_block(steps, "at", block_us).withColumn(
        "_level", F.sum("step").over(blocks.within([by], "at", "kind")))
    folded = local.groupBy(by, blocks.BLOCK).agg(F.sum("step").alias("_sum"), F.max("_level").alias("_high"))
    start = F.coalesce(F.sum("_sum").over(blocks.earlier_blocks([by])), F.lit(0))
    return folded.withColumn("_high", start + F.col("_high")).groupBy(by).agg(F.max("_high").alias("peak"))


def bursts(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event, error and slow counts per time window."""
    at = F.timestamp_micros("started_us")
    return events.groupBy(F.window(at, size, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("error") != "").alias("errors"),
        F.count_if(F.col("slow")).alias("slow"),
    ).select(
        F.unix_micros("w.start").alias("window_start_us"), F.unix_micros("w.end").alias("window_end_us"),
        "events", "errors", "slow")
