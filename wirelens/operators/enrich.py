"""Event enrichment: template, slow flag, N+1 verdict, alerts, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..options import Options
from . import blocks, cooldown
from .materialize import materialize

_KEY = ["n_plus_1_scope", "normalized_query"]


def slow_flag(duration_ms: Column, slow_ms: float) -> Column:
    return duration_ms >= slow_ms if slow_ms > 0 else F.lit(False)


def scope_of() -> Column:
    return F.when(F.col("tx_id") != "", F.col("tx_id")).otherwise(F.col("connection_id"))


def add_basics(df: DataFrame, options: Options) -> DataFrame:
    """Everything that depends on the row alone."""
    candidate = text.is_nplus1_candidate(F.col("operation"), F.col("query"))
    return df.withColumns({
        "slow": slow_flag(F.col("duration_ms"), options.slow_ms),
        "normalized_query": text.normalize_sql(F.col("query")),
        "n_plus_1_scope": F.when(candidate, scope_of()).otherwise(""),
    })


def candidates(events: DataFrame) -> DataFrame:
    """Narrow rows of the events that N+1 detection looks at."""
    return events.where((F.col("n_plus_1_scope") != "") & (F.col("normalized_query") != "")).select(
        *_KEY, "sequence", "started_us", text.args_signature(F.col("args"), F.col("query")).alias("signature"))


def window_hits(rows: DataFrame, window_us: int, block_us: int) -> DataFrame:
    """Hits and distinct signatures of each key in the window that ends at each row.

    A row enters the window at its start and leaves after ``window_us``; its
    signature enters unless the previous equal one is still inside, and leaves
    unless the next equal one comes in time. Both counts are then running sums
    over entries and departures: linear work, however many hits a window holds.
    Relies on starts not falling along ``sequence`` inside one key, which FIFO
    request pairing guarantees.
    """
    signed = [*_KEY, "signature"]
    placed = blocks.with_block(rows, "started_us", block_us)
    around = blocks.carry_in(
        placed, signed,
        {"_first": F.min("started_us"), "_last": F.max("started_us")},
        {"_before": lambda: F.max("_last").over(blocks.earlier_blocks(signed)),
         "_after": lambda: F.min("_first").over(blocks.later_blocks(signed))},
    )
    here = blocks.Window.partitionBy(*signed, blocks.BLOCK).orderBy("started_us", "sequence")
    at = F.col("started_us")
    previous = F.coalesce(F.lag("started_us").over(here), F.col("_before"))
    following = F.coalesce(F.lead("started_us").over(here), F.col("_after"))
    counted = F.col("signature") != ""
    steps = around.withColumns({
        "_enters": (counted & F.coalesce(previous < at - window_us, F.lit(True))).cast("int"),
        "_leaves": (counted & F.coalesce(following > at + window_us, F.lit(True))).cast("int"),
    }).select(
        *_KEY, "sequence",
        F.explode(F.array(
            F.struct(at.alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("hit"), F.col("_enters").alias("distinct")),
            F.struct((at + window_us).alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("hit"),
                     (-F.col("_leaves")).alias("distinct")),
        )).alias("step"),
    ).select(*_KEY, "sequence", "step.*")

    earlier = blocks.earlier_blocks(_KEY)
    swept = blocks.carry_in(
        blocks.with_block(steps, "at", block_us), _KEY,
        {"_hit": F.sum("hit"), "_distinct": F.sum("distinct")},
        {"_hits_in": lambda: F.sum("_hit").over(earlier), "_distinct_in": lambda: F.sum("_distinct").over(earlier)},
    )
    run = blocks.within(_KEY, "at", "kind", "sequence")
    return swept.withColumns({
        "n_plus_1_hits": F.coalesce(F.col("_hits_in"), F.lit(0)) + F.sum("hit").over(run),
        "n_plus_1_distinct_args": F.coalesce(F.col("_distinct_in"), F.lit(0)) + F.sum("distinct").over(run),
    }).where(F.col("kind") == 0).select(*_KEY, "sequence", F.col("at").alias("started_us"), "n_plus_1_hits", "n_plus_1_distinct_args")


def is_match(threshold: int) -> Column:
    if threshold <= 0:
        return F.lit(False)
    return (F.col("n_plus_1_hits") >= threshold) & (F.col("n_plus_1_distinct_args") >= min(2, threshold))


def detect_nplus1(events: DataFrame, options: Options) -> DataFrame:
    """Add hits, distinct arguments and the verdict; needs ``add_basics`` columns."""
    none = F.lit(0).cast("bigint")
    if options.nplus1_threshold <= 0:
        return events.withColumns({
            "n_plus_1_hits": none, "n_plus_1_distinct_args": none, "n_plus_1": F.lit(False)})
    rows = candidates(events)
    width = blocks.fitting_width(rows, _KEY, "started_us", options.block_us, options.block_most)
    counts = window_hits(rows, options.window_us, width)
    # The sequence is unique, so this join cannot be skewed.
    joined = events.join(counts.select("sequence", "n_plus_1_hits", "n_plus_1_distinct_args"), "sequence", "left")
    return joined.withColumns({
        "n_plus_1_hits": F.coalesce("n_plus_1_hits", none),
        "n_plus_1_distinct_args": F.coalesce("n_plus_1_distinct_args", none),
    }).withColumn("n_plus_1", is_match(options.nplus1_threshold))


def enrich(df: DataFrame, options: Options) -> DataFrame:
    """Assembled events -> query events with every derived column.

    The row-wise columns are written first: detection reads the few columns it
    needs from there several times, and the result joins to it once.
    """
    return detect_nplus1(materialize(add_basics(df, options)), options)


def nplus1_alerts(events: DataFrame, options: Options) -> DataFrame:
    """Matches that fire an alert, with the notice text."""
    matched = events.where("n_plus_1").select(
        *_KEY, "sequence", "started_us", "n_plus_1_hits", "n_plus_1_distinct_args")
    fired = cooldown.fired(matched, _KEY, "started_us", "sequence", options.cooldown_us)
    alerts = matched.join(fired.select(F.col("seq").alias("sequence")), "sequence", "left_semi")
    return alerts.withColumn("notice", notice_text(options.max_notice_chars))


def notice_text(limit: int) -> Column:
    line = F.format_string(
        "N+1 detected in %s (%d hits, %d distinct args): %s", "n_plus_1_scope", "n_plus_1_hits",
        "n_plus_1_distinct_args", text.compact_query(F.col("normalized_query"), 160))
    return text.truncate_text(line, limit)
