"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wirelens.operators import analytics, assemble, enrich, ranking, timeline, transactions
from wirelens.plans import fixtures
from wirelens.plans.catalog import QUERIES
from wirelens.sources import sinks

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    options = fixtures.TRACE
    # One small run first: JVM start and class loading are not what is measured.
    consume(fixtures.raw_trace(spark, FOLDER).groupBy("operation").count())

    def events() -> DataFrame:
        return fixtures.trace(spark, FOLDER)

    runs: dict[str, Callable[[], None]] = {
        # From the source table to complete events: transactions, templates, N+1.
        "enrich_nplus1": lambda: consume(fixtures.fresh_trace(spark, FOLDER)),
        # The event table that the analyses below read (written by the first use).
        "event_table": lambda: consume(events()),
        "template_analytics": lambda: consume(ranking.analytics_order(analytics.analytics(events()))),
        "transaction_summary": lambda: consume(transactions.tx_summary(events())),
        "nplus1_alerts": lambda: consume(enrich.nplus1_alerts(events(), options)),
        "summary_report": lambda: consume(sinks.summary_report(events())),
        "grouped_list": lambda: consume(timeline.grouped_list(events(), options.block_rows)),
        "time_bins": lambda: consume(timeline.time_bins(events(), 120)),
        "filter": lambda: consume(sinks.visible(events(), filter_line="(error or slow or n+1) and not op:begin d>50ms")),
        "fifo_pairing": lambda: consume(assemble.pair_requests(assemble.scan_messages(fixtures.messages(spark, FOLDER), options.block_rows))),
        "assemble_events": lambda: consume(assemble.assemble_events(fixtures.messages(spark, FOLDER), options)),
        "decode_binds": lambda: consume(QUERIES["dec4_bind"][0](spark, FOLDER)),
        "stream_nplus1": lambda: consume(QUERIES["str2_nplus1"][0](spark, FOLDER)),
    }
    # Each query runs twice; the first run compiles its code, the second is the
    # steady state that matters for long jobs. Streams run once.
    seconds: dict[str, float] = {}
    first_run: dict[str, float] = {}
    for name, run in runs.items():
        for attempt in range(1 if name.startswith("stream") else 2):
            start = time.perf_counter()
            run()
            seconds[name] = round(time.perf_counter() - start, 3)
            first_run.setdefault(name, seconds[name])
    rows = events().count()
    inputs = {name: rows for name in seconds} | {"decode_binds": fixtures.table(spark, FOLDER, "orders").count()}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "first_run": first_run,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "rows": rows,
        "rows_per_second": {name: round(inputs[name] / s) for name, s in seconds.items() if s > 0},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
