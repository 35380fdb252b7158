"""Orders and top-k lists. Limits run as take-ordered: k rows per task, one merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text

_ANALYTICS = {
    "total": ["total_duration_ms"], "count": ["count"], "avg": ["avg_duration_ms"], "p95": ["p95_duration_ms"],
    "max": ["max_duration_ms"], "rows": ["total_rows"], "errors": ["error_count", "total_duration_ms"],
    "nplus1": ["n_plus_1_count", "count"],
}
ANALYTICS_MODES = list(_ANALYTICS)

_QUERIES = {
    "slow": ["slow_count", "total_us", "max_exact_ms", "count"],
    "n_plus_1": ["n_plus_1_count", "count", "total_us"],
    "errors": ["error_count", "count", "total_us"],
}


def list_order(events: DataFrame, mode: str = "time") -> DataFrame:
    if mode == "duration":
        return events.orderBy(F.desc("duration_ms"), "sequence")
    return events.orderBy("sequence")


def analytics_order(rows: DataFrame, mode: str = "total") -> DataFrame:
    """Template analytics by one of the eight modes; unknown modes mean ``total``."""
    figures = _ANALYTICS.get(mode, _ANALYTICS["total"])
    return rows.orderBy(*[F.desc(f) for f in figures], "query")


def top_queries(base: DataFrame, kind: str, n: int) -> DataFrame:
    """Top templates for ``slow``, ``n_plus_1`` or ``errors``, from ``report_base`` rows.

    Equal templates keep the order in which they were first seen.
    """
    from .analytics import _REPORT, _regroup

    stats = base.groupBy("query").agg(*_regroup(*_REPORT)).withColumn("max_exact_ms", F.col("max_duration_ms"))
    figures = _QUERIES[kind]
    return (
        stats.where(F.col(figures[0]) > 0).orderBy(*[F.desc(f) for f in figures], "first_sequence").limit(max(1, n))
        .withColumns({
            "total_duration_ms": F.round(F.col("total_us") / 1000.0, 3),
            "avg_duration_ms": F.round(F.col("total_us") / 1000.0 / F.col("count"), 3),
            "max_duration_ms": F.round("max_duration_ms", 3),
        }).drop("total_us", "max_exact_ms")
    )


def event_snapshot(events: DataFrame) -> DataFrame:
    """Events as the report shows them."""
    return events.select(
        "sequence", text.iso_time(F.col("started_us")).alias("time"), "connection_id", "tx_id", "operation",
        text.shown_status().alias("status"), F.round("duration_ms", 3).alias("duration_ms"), "rows_affected",
        F.col("response_total_rows").alias("response_rows"), F.col("response_total_bytes").alias("response_bytes"),
        "error", "slow", "n_plus_1", "n_plus_1_hits", "n_plus_1_distinct_args",
        text.compact_query(F.col("query"), 300).alias("query"),
    )


_EVENTS = {
    "slow": (lambda: F.col("slow"), ["duration_ms"]),
    "n_plus_1": (lambda: F.col("n_plus_1"), ["n_plus_1_hits", "duration_ms"]),
    "errors": (lambda: F.col("error") != "", ["duration_ms"]),
}


def top_of(snapshots: DataFrame, kind: str, n: int) -> DataFrame:
    return snapshots.orderBy(*[F.desc(f) for f in _EVENTS[kind][1]], F.desc("sequence")).limit(max(1, n))


def top_events(events: DataFrame, kind: str, n: int) -> DataFrame:
    """Top events of one kind, by the rounded duration the report shows."""
    return top_of(event_snapshot(events.where(_EVENTS[kind][0]())), kind, n)


def last_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("sequence")).limit(n)


def last_notices(alerts: DataFrame, n: int) -> DataFrame:
    return alerts.select("sequence", "notice").orderBy(F.desc("sequence")).limit(n)
