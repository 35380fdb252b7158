"""Template metrics, report figures and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from . import blocks
from .assemble import fifo_counts

_TEMPLATE = "normalized_query"

# Value buckets per power of two in the percentile search.
_BUCKETS = 256


def drop_tx_control(events: DataFrame) -> DataFrame:
    """Events that count as statements: no BEGIN/COMMIT/ROLLBACK, no empty template."""
    return events.where(~F.col("operation").isin(*text.TX_CONTROL) & (F.col(_TEMPLATE) != ""))


def duration_us() -> Column:
    """Whole microseconds: their sums do not depend on the order of shuffled rows."""
    return F.round(F.col("duration_ms") * 1000.0).cast("bigint")


def _sums() -> dict[str, Column]:
    return {
        "count": F.count(F.lit(1)),
        "total_us": F.sum(duration_us()),
        "max_duration_ms": F.max("duration_ms"),
        "total_rows": F.sum("rows_affected"),
        "error_count": F.count_if(F.col("error") != ""),
        "slow_count": F.count_if(F.col("slow")),
        "n_plus_1_count": F.count_if(F.col("n_plus_1")),
    }


_REGROUP = {
    "count": F.sum, "total_us": F.sum, "max_duration_ms": F.max, "total_rows": F.sum, "error_count": F.sum,
    "slow_count": F.sum, "n_plus_1_count": F.sum, "total_response_bytes": F.sum, "first_sequence": F.min,
}


def _regroup(*names: str) -> list[Column]:
    return [_REGROUP[n](n).alias(n) for n in names]


def template_metrics(events: DataFrame, distinct: bool = True) -> DataFrame:
    """Sums per template, and the number of connections and transactions.

    Rows are first combined per (template, connection, transaction), so the
    distinct counts run over those few rows and not over a multiplied input.
    """
    finer = ["connection_id", "tx_id"] if distinct else []
    grouped = events.groupBy(_TEMPLATE, *finer).agg(*[c.alias(n) for n, c in _sums().items()])
    if distinct:
        grouped = grouped.groupBy(_TEMPLATE).agg(
            *_regroup(*_sums()),
            F.count_distinct("connection_id").alias("connection_count"),
            F.count_distinct(F.when(F.col("tx_id") != "", F.col("tx_id"))).alias("transaction_count"),
        )
    return grouped.withColumns({
        "total_duration_ms": F.col("total_us") / F.lit(1000.0),
        "avg_duration_ms": F.col("total_us") / F.lit(1000.0) / F.col("count"),
    }).drop("total_us")


def lower_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The value at index ``int((n - 1) * share)`` of each key's sorted values.

    Equal values are counted first. A histogram of the counts (a bounded number
    of buckets per key) finds the bucket that holds the index; only that bucket
    is then put in order. No key is ever sorted as a whole.
    """
    keys = list(keys)
    bucket = F.when(F.col(value) > 0, F.floor(F.log2(F.col(value)) * _BUCKETS)).otherwise(F.lit(-(2**31))).cast("bigint")
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    histogram = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    index = F.floor((F.col("_total") - 1) * F.lit(float(share)))
    chosen = (
        histogram.withColumns({"_upto": upto, "_total": total}).withColumn("_index", index)
        .where((F.col("_upto") > F.col("_index")) & (F.col("_upto") - F.col("_n") <= F.col("_index")))
        .select(*keys, "_bucket", (F.col("_index") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    inside = F.sum("_n").over(
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return (
        counts.join(chosen, [*keys, "_bucket"]).withColumn("_upto", inside)
        .where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_n") <= F.col("_rest")))
        .select(*keys, F.col(value).alias(name))
    )


def sample_queries(events: DataFrame, sample_order: str = "time") -> DataFrame:
    """First query of each template by sequence, or the slowest one."""
    order = F.struct("sequence") if sample_order == "time" else F.struct(-F.col("duration_ms"), "sequence")
    return events.where(F.col("query") != "").groupBy(_TEMPLATE).agg(F.min_by("query", order).alias("sample_query"))


def analytics(events: DataFrame, sample_order: str = "time") -> DataFrame:
    """Template analytics with p95 and a sample query."""
    rows = drop_tx_control(events)
    return (
        template_metrics(rows)
        .join(lower_percentile(rows, [_TEMPLATE], "duration_ms", 0.95, "p95_duration_ms"), _TEMPLATE)
        .join(sample_queries(rows, sample_order), _TEMPLATE, "left")
        .withColumn("sample_query", F.coalesce("sample_query", _TEMPLATE))
        .withColumnRenamed(_TEMPLATE, "query")
        .select("query", "sample_query", "count", "total_duration_ms", "avg_duration_ms", "p95_duration_ms",
                "max_duration_ms", "total_rows", "error_count", "slow_count", "n_plus_1_count",
                "connection_count", "transaction_count")
    )


def export_analytics(events: DataFrame) -> DataFrame:
    """Template figures as exported; transaction control statements stay in."""
    rows = events.where(F.col(_TEMPLATE) != "")
    return (
        template_metrics(rows, distinct=False)
        .join(lower_percentile(rows, [_TEMPLATE], "duration_ms", 0.95, "p95_ms"), _TEMPLATE)
        .select(
            F.col(_TEMPLATE).alias("query"), "count", F.col("total_duration_ms").alias("total_ms"),
            F.col("avg_duration_ms").alias("avg_ms"), "p95_ms", F.col("max_duration_ms").alias("max_ms"),
            F.col("total_rows").alias("rows_total"), F.col("error_count").alias("errors"),
            F.col("slow_count").alias("slow"), F.col("n_plus_1_count").alias("n_plus_1"),
        )
    )


def report_key() -> Column:
    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    return F.coalesce(filled(F.col(_TEMPLATE)), filled(text.normalize_sql(F.col("query"))), F.lit("(empty query)"))


def report_base(events: DataFrame) -> DataFrame:
    """Sums per (operation, template): all report figures follow from these rows."""
    keyed = events.withColumns({
        "operation": F.when(F.col("operation") != "", F.col("operation")).otherwise("Unknown"), "query": report_key()})
    return keyed.groupBy("operation", "query").agg(
        *[c.alias(n) for n, c in _sums().items()],
        F.sum("response_total_bytes").alias("total_response_bytes"), F.min("sequence").alias("first_sequence"),
    )


_REPORT = ["count", "total_us", "max_duration_ms", "total_rows", "error_count", "slow_count", "n_plus_1_count",
           "total_response_bytes", "first_sequence"]


def totals_of(base: DataFrame) -> DataFrame:
    return base.agg(*_regroup(*_REPORT)).select(
        F.coalesce("count", F.lit(0)).alias("events"), F.coalesce("error_count", F.lit(0)).alias("errors"),
        F.coalesce("slow_count", F.lit(0)).alias("slow"), F.coalesce("n_plus_1_count", F.lit(0)).alias("n_plus_1"),
        F.coalesce(F.round(F.col("total_us") / 1000.0, 3), F.lit(0.0)).alias("total_duration_ms"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("total_response_bytes", F.lit(0)).alias("total_response_bytes"),
    )


def histogram_of(base: DataFrame) -> DataFrame:
    return base.groupBy("operation").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "operation")


def query_stats_of(base: DataFrame) -> DataFrame:
    """Per template; sorted and filtered on exact figures, rounded when shown."""
    return base.groupBy("query").agg(*_regroup(*_REPORT)).withColumns({
        "total_duration_ms": F.round(F.col("total_us") / 1000.0, 3),
        "avg_duration_ms": F.round(F.col("total_us") / 1000.0 / F.col("count"), 3),
        "max_duration_ms": F.round("max_duration_ms", 3),
    }).drop("total_us")


def report_totals(events: DataFrame) -> DataFrame:
    return totals_of(report_base(events))


def operation_histogram(events: DataFrame) -> DataFrame:
    return histogram_of(report_base(events))


def first_queries(stats: DataFrame, events: DataFrame) -> DataFrame:
    """Add the first query of each template as ``sample_query``.

    ``first_sequence`` is unique, so the join is even.
    """
    texts = events.select(F.col("sequence").alias("first_sequence"), F.col("query").alias("_text"))
    return stats.join(texts, "first_sequence").withColumn(
        "sample_query", F.when(F.col("_text") != "", F.col("_text")).otherwise(F.col("query"))).drop("_text")


def report_query_stats(events: DataFrame) -> DataFrame:
    return first_queries(query_stats_of(report_base(events)), events).drop("first_sequence")


def report_rollup(events: DataFrame) -> DataFrame:
    """Totals, operations and templates of the report from one pass over the events.

    The grouping sets expand the combined rows, not the events.
    """
    base = report_base(events)
    sets = base.groupingSets([[], ["operation"], ["query"]], "operation", "query").agg(
        F.grouping_id().alias("_level"), *_regroup(*_REPORT))
    level = F.when(F.col("_level") == 3, "total").when(F.col("_level") == 1, "operation").otherwise("query")
    name = F.coalesce("operation", "query", F.lit(""))
    return sets.select(
        level.alias("level"), name.alias("name"), "count",
        F.round(F.col("total_us") / 1000.0, 3).alias("total_duration_ms"), "max_duration_ms", "total_rows",
        "error_count", "slow_count", "n_plus_1_count", "total_response_bytes",
    )


def counters(events: DataFrame) -> DataFrame:
    """Running totals shown in the header: one row."""
    return events.agg(
        F.count(F.lit(1)).alias("total_captured"), F.count_if(F.col("error") != "").alias("error_count"),
        F.count_if(F.col("slow")).alias("slow_count"), F.count_if(F.col("n_plus_1")).alias("nplus1_count"),
    )


def active_connections(log: DataFrame, block_rows: int = 65536, fan: int = 64) -> DataFrame:
    """Open connections after each log row (``order``, ``action``), never below zero.

    The log has no key, so its blocks are scanned by a tree (``fan`` blocks meet at a time).
    """
    counted = fifo_counts(log, [], "order", F.col("action") == "open", F.col("action") == "close", block_rows, fan=fan)
    return counted.select("order", "action", F.col("depth").alias("active_connections"))
