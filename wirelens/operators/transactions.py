"""Transactions: assignment of events, summaries, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from . import blocks

# An upper bound on the queries that can show in a 120-character preview: every
# further query adds at least the two characters of its separator.
_PREVIEW_CHARS = 120
_PREVIEW_QUERIES = _PREVIEW_CHARS // 2 + 4


def assign_transactions(df: DataFrame, order: str = "sequence", block_rows: int = 65536) -> DataFrame:
    """Add ``tx_id`` (``connection:n``, '' outside) and let control words name the operation.

    Text starting BEGIN opens a transaction even inside another; COMMIT and
    ROLLBACK close the one they belong to.
    """
    keys = ["connection_id"]
    control = text.tx_control(F.col("query"))
    # Order and kind of a control statement in one number, so that the latest
    # one is a plain maximum.
    staged = blocks.with_block(
        df.withColumn("_control", control)
        .withColumn("_begin", F.coalesce(F.col("_control") == "BEGIN", F.lit(False)).cast("bigint"))
        .withColumn("_code", F.when(F.col("_control").isNotNull(), F.col(order) * 2 + F.col("_begin"))),
        order, block_rows,
    )
    earlier = blocks.earlier_blocks(keys)
    carried = blocks.carry_in(
        staged, keys,
        {"_f_code": F.max("_code"), "_f_begin": F.sum("_begin")},
        {"_c_code": lambda: F.max("_f_code").over(earlier), "_c_begin": lambda: F.sum("_f_begin").over(earlier)},
    )
    last_code = F.greatest(F.max("_code").over(blocks.before(keys, order)), F.col("_c_code"))
    number = F.coalesce(F.col("_c_begin"), F.lit(0)) + F.sum("_begin").over(blocks.within(keys, order))
    inside = (F.col("_begin") == 1) | F.coalesce(F.pmod(last_code, F.lit(2)) == 1, F.lit(False))
    assigned = carried.withColumns({
        "tx_id": F.when(inside, F.concat_ws(":", "connection_id", number.cast("string"))).otherwise(""),
    })
    if "operation" in df.columns:
        assigned = assigned.withColumn("operation", F.coalesce("_control", "operation"))
    return assigned.drop("_control", "_begin", "_code", "_c_code", "_c_begin", blocks.BLOCK)


def end_us() -> Column:
    return F.col("started_us") + F.round(F.col("duration_ms") * 1000.0).cast("bigint")


def _count(flag: Column) -> Column:
    return F.count_if(flag)


def _measures() -> dict[str, Column]:
    return {
        "started_us": F.min("started_us"),
        "finished_us": F.max(end_us()),
        "rows_affected": F.sum("rows_affected"),
        "event_count": F.count(F.lit(1)),
        "error_count": _count(F.col("error") != ""),
        "slow_count": _count(F.col("slow")),
        "n_plus_1_count": _count(F.col("n_plus_1")),
        "first_sequence": F.min("sequence"),
    }


def tx_measures(events: DataFrame) -> DataFrame:
    """Figures per transaction; combined on the map side, so a long transaction is no burden.

    A transaction belongs to one connection, so both are the key and every figure is
    a number: the aggregate hashes and never sorts the events.
    """
    grouped = events.where(F.col("tx_id") != "").groupBy("tx_id", "connection_id").agg(*[c.alias(n) for n, c in _measures().items()])
    return grouped.withColumn("duration_ms", F.greatest((F.col("finished_us") - F.col("started_us")) / 1000.0, F.lit(0.0)))


def tx_previews(events: DataFrame) -> DataFrame:
    """First queries of each transaction, joined and cut to 120 characters."""
    spoken = events.where((F.col("tx_id") != "") & (F.col("query") != "")).select("tx_id", "sequence", "query")
    head = blocks.first_rows(spoken, ["tx_id"], ["sequence"], _PREVIEW_QUERIES)
    ordered = F.array_sort(F.collect_list(F.struct("sequence", "query")))
    joined = F.array_join(F.transform(ordered, lambda row: row["query"]), "; ")
    return head.groupBy("tx_id").agg(text.compact_query(joined, _PREVIEW_CHARS).alias("query_preview"))


def tx_summary(events: DataFrame) -> DataFrame:
    """One row per transaction."""
    previews = tx_previews(events)
    return tx_measures(events).join(previews, "tx_id", "left").withColumn(
        "query_preview", F.coalesce("query_preview", F.lit("(transaction)")))


def export_transactions(events: DataFrame) -> DataFrame:
    """Transaction figures as exported: no preview, times as text."""
    return tx_measures(events).select(
        "tx_id", "connection_id", "event_count", "rows_affected", "error_count", "slow_count", "n_plus_1_count",
        text.iso_time(F.col("started_us")).alias("started_at"),
        text.iso_time(F.col("finished_us")).alias("finished_at"), "duration_ms",
    )


def per_block(events: DataFrame, table: DataFrame, block_rows: int) -> DataFrame:
    """Copy per-transaction rows to the (transaction, block) pairs that occur.

    Joining events on that pair instead of on the transaction alone spreads a
    long transaction over many tasks.
    """
    pairs = blocks.with_block(events.where(F.col("tx_id") != ""), "sequence", block_rows).select("tx_id", blocks.BLOCK).distinct()
    return pairs.join(table, "tx_id")


def with_tx_summary(events: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Attach to each event the summary of its transaction (nulls outside one)."""
    summary = tx_summary(events)
    named = summary.select("tx_id", *[F.col(c).alias(f"tx_{c}") for c in summary.columns if c != "tx_id"])
    spread = per_block(events, named, block_rows)
    blocked = blocks.with_block(events, "sequence", block_rows)
    return blocked.join(spread, ["tx_id", blocks.BLOCK], "left").drop(blocks.BLOCK)


def tx_context(events: DataFrame, selected: DataFrame, block_rows: int = 65536) -> DataFrame:
    """All events of the transactions that ``selected`` events belong to, in order.

    The result holds each event once: the size of the transactions, not the
    number of event pairs.
    """
    wanted = selected.where(F.col("tx_id") != "").select("tx_id").distinct()
    spread = per_block(events, wanted, block_rows)
    members = blocks.with_block(events.where(F.col("tx_id") != ""), "sequence", block_rows).join(
        spread, ["tx_id", blocks.BLOCK], "left_semi")
    shown = F.when(F.col("query") != "", F.col("query")).otherwise(F.col("operation"))
    return members.select(
        "tx_id", "sequence", "operation", "duration_ms", text.event_status().alias("status"),
        text.compact_query(shown, 140).alias("query"),
    )


def tx_groups(events: DataFrame) -> DataFrame:
    """First sequence of each transaction."""
    return events.where(F.col("tx_id") != "").groupBy("tx_id").agg(F.min("sequence").alias("first_sequence"))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
