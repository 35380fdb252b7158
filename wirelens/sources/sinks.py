"""Records, exports, reports and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.filters import compile_filter, matches_search
from ..operators import analytics, blocks, ranking
from ..operators.materialize import materialize
from ..operators.transactions import export_transactions

Sink = Callable[[DataFrame, int], None]


def visible(events: DataFrame, search: str = "", filter_line: str = "") -> DataFrame:
    """Events that pass the structured filter and the free-text search."""
    return events.where(compile_filter(filter_line) & matches_search(search))


def _response(mode: str) -> Column:
    fields = [F.col("response_total_rows").alias("rows"), F.col("response_total_bytes").alias("bytes")]
    if mode == "preview":
        fields += [
            F.col("response_columns").alias("columns"), F.col("response_rows").alias("preview_rows"),
            F.size("response_rows").alias("preview_count"), F.col("response_truncated").alias("truncated"),
        ]
    return F.struct(*fields)


def record_columns(profile: str = "default", response: str = "none") -> list[Column]:
    columns = [
        text.iso_time(F.col("started_us")).alias("time"), F.col("operation"), F.col("query"), F.col("duration_ms"),
        F.col("rows_affected"), F.when(F.col("status_tag") != "", F.col("status_tag")).otherwise("OK").alias("status"),
        _response(response).alias("response"),
    ]
    more = []
    if profile in ("default", "full"):
        more += ["connection_id", "tx_id", "args", "error", "slow", "n_plus_1", "n_plus_1_scope", "n_plus_1_hits",
                 "n_plus_1_distinct_args", "normalized_query"]
    if profile == "full":
        more += ["event_id", "sequence", "response_truncated", "response_columns"]
    return columns + [F.col(c) for c in more]


def event_record(events: DataFrame, profile: str = "default", response: str = "none") -> DataFrame:
    """Events as exported records: ``minimal``, ``default`` or ``full``."""
    return events.select(*record_columns(profile, response))


def write_jsonl(events: DataFrame, path: str, profile: str = "default", response: str = "none",
                filter_line: str = "", mode: str = "append") -> None:
    event_record(visible(events, filter_line=filter_line), profile, response).write.mode(mode).json(path)


def write_json_document(events: DataFrame, path: str, profile: str = "default", response: str = "none",
                        filter_line: str = "", shard_rows: int = 1024) -> None:
    """Records inside a JSON document with its header.

    Always a folder of documents, one for every ``shard_rows`` sequence numbers,
    each with the same header and its part of ``queries``: no document grows with
    the result.
    """
    kept = blocks.with_block(visible(events, filter_line=filter_line), "sequence", shard_rows)
    captured = kept.groupBy().agg(F.count(F.lit(1)).alias("n"))
    whole = kept.select(
        F.col(blocks.BLOCK).alias("shard"), "sequence", F.struct(*record_columns(profile, response)).alias("record"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "record"))), lambda r: r["record"])
    documents = whole.groupBy("shard").agg(ordered.alias("queries")).select(
        "shard",
        F.to_json(F.struct(
            captured.scalar().alias("captured"), F.lit(filter_line).alias("filter"), F.lit(profile).alias("profile"),
            F.lit(response).alias("response_body"), "queries")).alias("value"))
    documents.write.partitionBy("shard").text(path)


def event_lines(events: DataFrame, response: str = "none") -> DataFrame:
    """Console lines, one string column; the response summary follows its event."""
    line = text.event_line()
    if response == "preview":
        indented = F.transform(text.response_lines(), lambda x: F.concat(F.lit("    "), x))
        line = F.array_join(F.concat(F.array(line), indented), "\n")
    return events.select("sequence", line.alias("line"))


def print_events(events: DataFrame, filter_line: str = "", response: str = "none") -> None:
    """Print every event in the order of its sequence; the driver holds a partition at a time."""
    for row in event_lines(visible(events, filter_line=filter_line), response).orderBy("sequence").toLocalIterator():
        print(row["line"])


# --- summary report ------------------------------------------------------------------

KINDS = ["slow", "n_plus_1", "errors"]


class Report:
    """Figures of the summary report, all from one combined table.

    The events are aggregated once to (operation, template) rows, which are
    materialized; totals, operations and top templates follow from those.
    """

    def __init__(self, events: DataFrame, top: int = 10, filter_line: str = "") -> None:
        self.events = visible(events, filter_line=filter_line)
        self.top = max(1, top)
        self.filter_line = filter_line
        self.base = materialize(analytics.report_base(self.events))

    def totals(self) -> DataFrame:
        return analytics.totals_of(self.base)

    def operations(self) -> DataFrame:
        return analytics.histogram_of(self.base)

    def queries(self, kind: str) -> DataFrame:
        """Top templates with their first query: at most ``top`` rows look it up."""
        top = ranking.top_queries(self.base, kind, self.top)
        texts = self.events.select(F.col("sequence").alias("first_sequence"), F.col("query").alias("_text"))
        found = texts.join(F.broadcast(top), "first_sequence")
        return found.select(
            "query", F.when(F.col("_text") != "", F.col("_text")).otherwise(F.col("query")).alias("sample_query"),
            "count", "total_duration_ms", "avg_duration_ms", "max_duration_ms", "error_count", "slow_count",
            "n_plus_1_count", "total_rows", "total_response_bytes", "first_sequence")

    def events_of(self, kind: str) -> DataFrame:
        return ranking.top_events(self.events, kind, self.top)


_RANKS = {
    "queries": {
        "slow": ["slow_count", "total_duration_ms", "max_duration_ms", "count"],
        "n_plus_1": ["n_plus_1_count", "count", "total_duration_ms"],
        "errors": ["error_count", "count", "total_duration_ms"],
    },
    "events": {"slow": ["duration_ms"], "n_plus_1": ["n_plus_1_hits", "duration_ms"], "errors": ["duration_ms"]},
}


def _top_list(rows: DataFrame, figures: Sequence[str], tie: Column, shown: Sequence[str]) -> DataFrame:
    """A top list (a few rows) as one sorted array."""
    order = F.struct(*[(-F.col(f)).alias(f"k{i}") for i, f in enumerate(figures)], tie.alias("tie"))
    packed = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*shown).alias("row"))))
    return rows.agg(F.transform(packed, lambda r: r["row"]).alias("rows"))


def _query_list(report: Report, kind: str) -> DataFrame:
    rows = report.queries(kind)
    shown = [c for c in rows.columns if c != "first_sequence"]
    return _top_list(rows, _RANKS["queries"][kind], F.col("first_sequence"), shown)


def _event_list(report: Report, kind: str) -> DataFrame:
    rows = report.events_of(kind)
    return _top_list(rows, _RANKS["events"][kind], -F.col("sequence"), rows.columns)


def report_struct(report: Report) -> DataFrame:
    """The whole report as one row: ``totals``, ``top_queries``, ``top_events``."""
    spark = report.events.sparkSession
    totals = report.totals()
    operations = report.base.groupBy("operation").agg(F.sum("count").alias("n")).agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("least"), F.col("operation").alias("name")))),
        lambda o: F.struct(o["name"], -o["least"]))).alias("operations"))
    figures = totals.select(F.struct(*totals.columns, operations.scalar().alias("operations")).alias("t"))
    return spark.range(1).select(
        F.lit(report.filter_line).alias("filter"), F.lit(report.top).alias("top_n"), figures.scalar().alias("totals"),
        F.struct(*[_query_list(report, k).scalar().alias(k) for k in KINDS]).alias("top_queries"),
        F.struct(*[_event_list(report, k).scalar().alias(k) for k in KINDS]).alias("top_events"),
    )


def summary_report(events: DataFrame, top: int = 10, filter_line: str = "", generated_at: Column | None = None) -> DataFrame:
    """Report as one JSON text."""
    at = text.iso_time(F.unix_micros(F.current_timestamp()))
    row = report_struct(Report(events, top, filter_line))
    return row.select(F.to_json(F.struct((at if generated_at is None else generated_at).alias("generated_at"), *row.columns)).alias("value"))


# Headings of the Markdown report.
_TABLES = [
    ("Top Slow Queries", "queries", "slow", "| # | Count | Slow | Max ms | Total ms | Query |",
     "|---|------:|-----:|-------:|---------:|-------|", ["count", "slow_count", "max_duration_ms", "total_duration_ms"]),
    ("Top N+1 Queries", "queries", "n_plus_1", "| # | Count | N+1 | Max ms | Query |",
     "|---|------:|----:|-------:|-------|", ["count", "n_plus_1_count", "max_duration_ms"]),
    ("Top Error Queries", "queries", "errors", "| # | Count | Errors | Max ms | Query |",
     "|---|------:|-------:|-------:|-------|", ["count", "error_count", "max_duration_ms"]),
    ("Top Slow Events", "events", "slow", "| # | Seq | ms | Status | Query |",
     "|---|----:|---:|--------|-------|", ["sequence", "duration_ms", "status"]),
]


def _cell(value: Column) -> Column:
    return text.escape_pipe(value.cast("string"))


def _table_line(columns: list[str]) -> Callable[[Column, Column], Column]:
    def line(r: Column, i: Column) -> Column:
        cells = [(i + 1).cast("string"), *[_cell(r[c]) for c in columns], _cell(text.compact_query(r["query"], 180))]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    return line


def report_markdown(events: DataFrame, top: int = 10, filter_line: str = "", title: str = "Summary report",
                    generated_at: Column | None = None) -> DataFrame:
    """Report as numbered Markdown lines; its size is bounded by ``top``."""
    at = F.substring(text.iso_time(F.unix_micros(F.current_timestamp())), 1, 19) if generated_at is None else generated_at
    row = report_struct(Report(events, top, filter_line))
    shown_filter = F.when(F.col("filter") != "", F.col("filter")).otherwise("(none)")
    figures = ["events", "errors", "slow", "n_plus_1", "total_duration_ms", "total_rows", "total_response_bytes"]
    head = [
        F.lit(f"# {title}"), F.lit(""), F.concat(F.lit("- generated_at: "), at),
        F.concat(F.lit("- filter: "), shown_filter), F.concat(F.lit("- top_n: "), F.col("top_n").cast("string")),
        F.lit(""), F.lit("## Totals"), F.lit(""),
        *[F.concat(F.lit(f"- {f}: "), F.col(f"totals.{f}").cast("string")) for f in figures],
    ]
    parts = [F.array(*head)]
    for heading, group, kind, names, rule, columns in _TABLES:
        parts.append(F.array(F.lit(""), F.lit(f"## {heading}"), F.lit(""), F.lit(names), F.lit(rule)))
        parts.append(F.transform(F.col(f"top_{group}.{kind}"), _table_line(columns)))
    return row.select(F.posexplode(F.concat(*parts)).alias("line_no", "value"))


def write_report(events: DataFrame, path: str, fmt: str = "json", top: int = 10, filter_line: str = "") -> None:
    lines = (report_markdown(events, top, filter_line).orderBy("line_no").select("value") if fmt == "markdown"
             else summary_report(events, top, filter_line))
    # A report has a bounded number of lines, so one file is right.
    lines.coalesce(1).write.mode("overwrite").text(path)


# --- exports -------------------------------------------------------------------------

def export_queries(events: DataFrame) -> DataFrame:
    return events.select(
        text.iso_time(F.col("started_us")).alias("time"), F.col("operation").alias("op"), "query", "args",
        "duration_ms", "rows_affected", "error", "tx_id", "n_plus_1", "n_plus_1_scope", "n_plus_1_hits",
        "n_plus_1_distinct_args", "slow", "normalized_query", F.col("response_total_rows").alias("response_rows"),
        F.col("response_total_bytes").alias("response_bytes"), "response_truncated")


def export_json(events: DataFrame, path: str, search: str = "", filter_line: str = "") -> None:
    """Visible events, their template figures and transactions, side by side under ``path``."""
    shown = visible(events, search, filter_line)
    header = shown.agg(F.count(F.lit(1)).alias("captured")).select(
        "captured", F.lit(search).alias("search"), F.lit(filter_line).alias("filter"))
    parts = {
        "header": header, "queries": export_queries(shown.orderBy("sequence")),
        "analytics": analytics.export_analytics(shown), "transactions": export_transactions(shown),
    }
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def markdown_rows(events: DataFrame, search: str = "", filter_line: str = "") -> DataFrame:
    """Visible events as numbered Markdown table lines."""
    numbered = blocks.number_rows(visible(events, search, filter_line), ["sequence"], "index")
    size = F.format_string("%d rows / %d B", "response_total_rows", "response_total_bytes")
    cells = [
        F.col("index").cast("string"), text.clock_time_ms(F.col("started_us")), _cell(F.col("operation")),
        _cell(text.format_ms(F.col("duration_ms"))), _cell(size), _cell(text.compact_query(F.col("query"), 200)),
        _cell(F.array_join("args", ", ")), _cell(F.col("error")),
    ]
    return numbered.select("index", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def export_markdown(events: DataFrame, path: str, search: str = "", filter_line: str = "", title: str = "Export") -> None:
    """Markdown table of the visible events, as ordered part files; the head is in the first."""
    rows = markdown_rows(events, search, filter_line)
    captured = visible(events, search, filter_line).agg(F.count(F.lit(1)).cast("string").alias("n"))
    head = events.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("index"), F.concat(
        F.lit(f"# {title}\n\n- Captured: "), captured.scalar(),
        F.lit(f"\n- Search: {search or '(none)'}\n- Filter: {filter_line or '(none)'}\n\n## Queries\n\n"
              "| # | Time | Op | Duration | Resp | Query | Args | Error |\n"
              "|---|------|----|----------|------|-------|------|-------|")).alias("value"))
    head.unionByName(rows).orderBy("index").select("value").write.mode("overwrite").text(path)


def response_export(events: DataFrame, chosen: Column) -> DataFrame:
    """Response of the chosen event(s) as JSON text."""
    return events.where(chosen).select("sequence", F.to_json(F.struct(
        F.struct(
            "event_id", "sequence", text.iso_time(F.col("started_us")).alias("time"), "connection_id", "tx_id",
            "operation", text.shown_status().alias("status"), "duration_ms", "rows_affected", "query", "args",
            "error", "slow", "n_plus_1", "n_plus_1_hits", "n_plus_1_distinct_args").alias("event"),
        F.struct(
            F.col("response_total_rows").alias("rows_total"), F.col("response_total_bytes").alias("bytes_total"),
            F.col("response_truncated").alias("truncated"), F.col("response_columns").alias("columns"),
            F.col("response_rows").alias("preview_rows"), F.size("response_rows").alias("preview_count")).alias("response"),
    )).alias("value"))


# --- sinks for streams ----------------------------------------------------------------

def jsonl_sink(path: str, profile: str = "default", response: str = "none", filter_line: str = "") -> Sink:
    """One folder per batch: a batch that is tried again replaces its own output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_jsonl(batch, f"{path}/batch={batch_id}", profile, response, filter_line, mode="overwrite")

    return write


def console_sink(filter_line: str = "", response: str = "none") -> Sink:
    """Prints every event of every batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        print_events(batch, filter_line, response)

    return write


def fan_out(sinks: Sequence[Sink]) -> Sink:
    """Give every batch to every sink; the batch is computed once."""
    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, batch_id)
        finally:
            kept.unpersist()

    return run
