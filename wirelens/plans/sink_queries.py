"""Registered queries over written files and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.filters import compile_filter
from ..operators.materialize import materialize, new_path
from ..sources import readers, sinks
from ..streaming import settled, streams
from . import oracle as O
from .event_queries import _QUERY_STATS, _SNAPSHOT, _TOTALS, _ANALYTICS, Query
from .fixtures import TRACE, messages, trace, trace_tx

QUERIES: dict[str, tuple[Query, str | None]] = {}


def add(name: str, answer: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = (query, answer)
        return query

    return keep


# --- records and documents -----------------------------------------------------------------

_RESPONSE = "response_total_rows as resp_rows, response_total_bytes as resp_bytes"
_MINIMAL = (f"{O.iso('started_us')} as time, operation, query, duration_ms, rows_affected, "
            f"case when status_tag <> '' then status_tag else 'OK' end as status, {_RESPONSE}")
_DEFAULT = (_MINIMAL + ", connection_id, tx_id, array_to_string(args, '|') as args, error, slow, n_plus_1, n_plus_1_scope, n_plus_1_hits, "
            "n_plus_1_distinct_args, normalized_query")
_FULL = _DEFAULT + ", event_id, sequence, response_truncated, array_to_string(response_columns, '|') as response_columns"


def _flat(records: DataFrame) -> DataFrame:
    """Records with nested fields as plain columns."""
    def plain(name: str) -> list[Column]:
        if name == "response":
            return [F.col("response.rows").alias("resp_rows"), F.col("response.bytes").alias("resp_bytes")]
        return [F.array_join(name, "|").alias(name)] if name in ("args", "response_columns") else [F.col(name)]

    return records.select(*[c for name in records.columns for c in plain(name)])


for _profile, _columns in (("minimal", _MINIMAL), ("default", _DEFAULT), ("full", _FULL)):
    QUERIES[f"snk1_record_{_profile}"] = (
        lambda spark, folder, profile=_profile: _flat(sinks.event_record(trace(spark, folder), profile)),
        O.events(f"select {_columns} from ev"))


@add("snk2_response_preview", O.events(
    "select sequence, response_total_rows as resp_rows, response_total_bytes as resp_bytes, array_to_string(response_columns, '|') as columns, "
    "case when len(response_rows) > 0 then array_to_string(response_rows[1], '|') else '' end as first_row, "
    "len(response_rows) as preview_count, response_truncated as truncated from ev"))
def _preview(spark: SparkSession, folder: str) -> DataFrame:
    records = sinks.event_record(trace(spark, folder), "full", "preview")
    r = F.col("response")
    return records.select(
        "sequence", r["rows"].alias("resp_rows"), r["bytes"].alias("resp_bytes"), F.array_join(r["columns"], "|").alias("columns"),
        F.coalesce(F.array_join(F.get(r["preview_rows"], F.lit(0)), "|"), F.lit("")).alias("first_row"),
        r["preview_count"].cast("bigint").alias("preview_count"), r["truncated"].alias("truncated"))


@add("src3_jsonl_events", O.events(f"select {_FULL} from ev"))
def _jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    sinks.write_jsonl(trace(spark, folder), path, "full")
    return _flat(readers.read_events(spark, path, "jsonl"))


@add("src4_json_document", O.events(f"select {_FULL} from ev where slow"))
def _document(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "document")
    sinks.write_json_document(trace(spark, folder), path, "full", filter_line="slow", shard_rows=TRACE.block_rows)
    return _flat(readers.read_events(spark, path, "json"))


@add("snk3_jsonl_filtered", O.events(f"select {_DEFAULT} from ev where error <> '' union all select {_DEFAULT} from ev where slow"))
def _jsonl_append(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "append")
    for line in ("error", "slow"):
        sinks.write_jsonl(trace(spark, folder), path, "default", filter_line=line)
    found = _flat(readers.read_events(spark, path, "jsonl"))
    return found.drop("event_id", "sequence", "response_truncated", "response_columns")


@add("snk4_document_header", O.events(
    f"select sequence // {TRACE.block_rows} * {TRACE.block_rows} as shard, (select count(*) from ev where slow) as captured, 'slow' as filter, "
    "'minimal' as profile, 'none' as response_body, count(*) as records from ev where slow group by 1"))
def _header(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "document")
    sinks.write_json_document(trace(spark, folder), path, "minimal", filter_line="slow", shard_rows=TRACE.block_rows)
    found = spark.read.schema("shard bigint, captured bigint, filter string, profile string, response_body string, queries array<struct<query:string>>").json(path, multiLine=True)
    return found.select("shard", "captured", "filter", "profile", "response_body", F.size("queries").cast("bigint").alias("records"))


@add("snk5_event_snapshot", O.events(_SNAPSHOT))
def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.ranking.event_snapshot(trace(spark, folder))


_LISTS = [
    ("queries", "slow", f"select query, count::varchar as figure, slow_count::varchar as second, sample_query as detail, row_number() over (order by slow_count desc, total_duration_ms desc, max_duration_ms desc, count desc, first_sequence) as rank from ({_QUERY_STATS}) where slow_count > 0"),
    ("queries", "n_plus_1", f"select query, count::varchar, n_plus_1_count::varchar, sample_query, row_number() over (order by n_plus_1_count desc, count desc, total_duration_ms desc, first_sequence) from ({_QUERY_STATS}) where n_plus_1_count > 0"),
    ("queries", "errors", f"select query, count::varchar, error_count::varchar, sample_query, row_number() over (order by error_count desc, count desc, total_duration_ms desc, first_sequence) from ({_QUERY_STATS}) where error_count > 0"),
    ("events", "slow", f"select query, sequence::varchar, n_plus_1_hits::varchar, status, row_number() over (order by duration_ms desc, sequence desc) from ({_SNAPSHOT}) where slow"),
    ("events", "n_plus_1", f"select query, sequence::varchar, n_plus_1_hits::varchar, status, row_number() over (order by n_plus_1_hits desc, duration_ms desc, sequence desc) from ({_SNAPSHOT}) where n_plus_1"),
    ("events", "errors", f"select query, sequence::varchar, n_plus_1_hits::varchar, status, row_number() over (order by duration_ms desc, sequence desc) from ({_SNAPSHOT}) where error <> ''"),
]


@add("snk6_report_lists", O.events(" union all ".join(
    f"select '{group}' as part, '{kind}' as kind, rank, query, figure, second, detail from ({sql}) t(query, figure, second, detail, rank) where rank <= 10"
    for group, kind, sql in _LISTS)))
def _report_lists(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "report")
    sinks.write_report(trace(spark, folder), path)
    entry = "array<struct<query:string,sample_query:string,count:bigint,slow_count:bigint,n_plus_1_count:bigint,error_count:bigint,sequence:bigint,n_plus_1_hits:bigint,status:string>>"
    lists = f"struct<slow:{entry},n_plus_1:{entry},errors:{entry}>"
    report = spark.read.schema(f"top_queries {lists}, top_events {lists}").json(path)
    parts = []
    for group, kind, _ in _LISTS:
        second = {"slow": "slow_count", "n_plus_1": "n_plus_1_count", "errors": "error_count"}[kind]
        row = report.select(F.posexplode(f"top_{group}.{kind}").alias("at", "r"))
        queries = group == "queries"
        parts.append(row.select(
            F.lit(group).alias("part"), F.lit(kind).alias("kind"), (F.col("at") + 1).cast("bigint").alias("rank"), F.col("r.query").alias("query"),
            F.col("r.count" if queries else "r.sequence").cast("string").alias("figure"),
            F.col(f"r.{second}" if queries else "r.n_plus_1_hits").cast("string").alias("second"),
            F.col("r.sample_query" if queries else "r.status").alias("detail")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@add("snk6_report_totals", O.events(
    f"select 10::bigint as top_n, 'slow or error' as filter, (select string_agg(operation || '=' || n, ',' order by n desc, operation) from "
    f"(select operation, count(*) as n from ev where slow or error <> '' group by 1)) as operations, {_TOTALS} from ev where slow or error <> ''"))
def _report_totals(spark: SparkSession, folder: str) -> DataFrame:
    text = sinks.summary_report(trace(spark, folder), 10, "slow or error")
    schema = ("filter string, top_n bigint, totals struct<events:bigint,errors:bigint,slow:bigint,n_plus_1:bigint,total_duration_ms:double,"
              "total_rows:bigint,total_response_bytes:bigint,operations:map<string,bigint>>")
    row = text.select(F.from_json("value", schema).alias("r"))
    counts = F.transform(F.map_entries("r.totals.operations"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    operations = F.array_join(F.transform(F.array_sort(counts), lambda e: F.concat(e["k"], F.lit("="), (-e["n"]).cast("string"))), ",")
    return row.select("r.top_n", "r.filter", operations.alias("operations"), *[
        F.col(f"r.totals.{c}").alias(c) for c in ("events", "errors", "slow", "n_plus_1", "total_duration_ms", "total_rows", "total_response_bytes")])


@add("snk7_report_markdown")
def _report_markdown(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "report")
    sinks.write_report(trace(spark, folder), path, "markdown")
    return spark.read.text(path)


def _export(spark: SparkSession, folder: str) -> str:
    path = new_path(spark, "export")
    sinks.export_json(trace(spark, folder), path, filter_line="slow or error", search="select")
    return path


_SHOWN = "ev where (slow or error <> '') and contains(lower(concat_ws(' ', query, array_to_string(args, ' '), error, normalized_query, array_to_string(response_columns, ' '))), 'select')"


@add("snk8_export_queries", O.events(
    f"select {O.iso('started_us')} as time, operation as op, query, array_to_string(args, '|') as args, duration_ms, rows_affected, error, tx_id, n_plus_1, "
    "n_plus_1_scope, n_plus_1_hits, n_plus_1_distinct_args, slow, normalized_query, response_total_rows as response_rows, "
    f"response_total_bytes as response_bytes, response_truncated from {_SHOWN}"))
def _export_queries(spark: SparkSession, folder: str) -> DataFrame:
    schema = sinks.export_queries(trace(spark, folder)).schema
    return spark.read.schema(schema).json(f"{_export(spark, folder)}/queries").withColumn("args", F.array_join("args", "|"))


@add("snk8_export_analytics", O.events(
    "select query, count, total_duration_ms as total_ms, avg_duration_ms as avg_ms, p95_duration_ms as p95_ms, max_duration_ms as max_ms, "
    "total_rows as rows_total, error_count as errors, slow_count as slow, n_plus_1_count as n_plus_1 from ("
    + _ANALYTICS.replace("from ev where operation not in ('BEGIN','COMMIT','ROLLBACK') and", f"from {_SHOWN} and") + ")"))
def _export_analytics(spark: SparkSession, folder: str) -> DataFrame:
    schema = sinks.analytics.export_analytics(trace(spark, folder)).schema
    return spark.read.schema(schema).json(f"{_export(spark, folder)}/analytics")


_MARKDOWN_ROWS = (
    "select row_number() over (order by sequence) as index, '| ' || row_number() over (order by sequence) || ' | ' || "
    "strftime(make_timestamp(started_us), '%H:%M:%S') || '.' || lpad((started_us // 1000 % 1000)::varchar, 3, '0') || ' | ' || operation || ' | ' "
    f"|| {O.format_ms('duration_ms')} || ' | ' || response_total_rows || ' rows / ' || response_total_bytes || ' B | ' "
    f"|| replace({O.compact('query', 200)}, '|', '\\|') || ' | ' || array_to_string(args, ', ') || ' | ' || error || ' |' as value from ev where slow")


@add("snk9_export_markdown", O.events(_MARKDOWN_ROWS))
def _markdown_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.markdown_rows(trace(spark, folder), filter_line="slow")


_HEAD = ["# Export", "", None, "- Search: (none)", "- Filter: slow", "", "## Queries", "", "| # | Time | Op | Duration | Resp | Query | Args | Error |",
         "|---|------|----|----------|------|-------|------|-------|"]


@add("snk9_export_markdown_file", O.events(
    " union all ".join("select '- Captured: ' || (select count(*) from ev where slow) as value" if x is None else f"select '{x}' as value" for x in _HEAD)
    + " union all select value from (" + _MARKDOWN_ROWS + ")"))
def _export_markdown(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "markdown")
    sinks.export_markdown(trace(spark, folder), path, filter_line="slow")
    return spark.read.text(path)


@add("snk10_response_export", O.events(
    f"select sequence, event_id, {O.SHOWN} as status, response_total_rows as rows_total, len(response_rows) as preview_count, "
    "array_to_string(response_columns, '|') as columns from ev where n_plus_1"))
def _response_export(spark: SparkSession, folder: str) -> DataFrame:
    exported = sinks.response_export(trace(spark, folder), F.col("n_plus_1"))
    schema = ("event struct<event_id:string,status:string>, response struct<rows_total:bigint,preview_count:bigint,columns:array<string>>")
    r = F.from_json("value", schema)
    return exported.withColumn("r", r).select(
        "sequence", "r.event.event_id", "r.event.status", "r.response.rows_total", "r.response.preview_count",
        F.array_join("r.response.columns", "|").alias("columns"))


_MARKS = ("coalesce(nullif(concat_ws(',', case when error <> '' then 'ERROR' end, case when n_plus_1 then 'N+1[' || n_plus_1_hits || '/' || n_plus_1_distinct_args || ']' end, "
          "case when slow then 'SLOW' end), ''), nullif(status_tag, ''), 'OK')")
_PREVIEW = """list_concat(['response_size: rows=' || response_total_rows || ' bytes=' || response_total_bytes],
    case when len(response_columns) > 0 then ['columns: ' || array_to_string(response_columns, ' | ')] else cast([] as varchar[]) end,
    case when len(response_rows) > 0 then list_transform(response_rows, lambda cells, n: 'row ' || n || ': ' || array_to_string(cells, ' | ')) else ['rows: (no preview rows)'] end,
    case when response_total_rows > 0 then ['preview: ' || len(response_rows) || ' of ' || response_total_rows || case when response_truncated then ' [truncated]' else '' end]
         when response_truncated then ['preview: truncated'] else cast([] as varchar[]) end)"""


@add("snk11_console_lines", O.events(
    "select sequence, printf('[%s] %-8s %8.2f ms rows=%-5d resp_rows=%-5d resp_bytes=%-7d conn=%s status=%s query=%s', strftime(make_timestamp(started_us), '%H:%M:%S'), operation, duration_ms, "
    f"rows_affected, response_total_rows, response_total_bytes, connection_id, {_MARKS}, {O.compact('query', 120)}) || "
    f"array_to_string(list_transform({_PREVIEW}, lambda x: chr(10) || '    ' || x), '') as line from ev where slow or error <> ''"))
def _console(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.event_lines(sinks.visible(trace(spark, folder), filter_line="slow or error"), "preview")


# --- streams: files of some days each, in order -------------------------------------------------

DAY_US = 86_400_000_000
PART_ROWS = 1 << 17
LATE = "2 days"


def _in_parts(spark: SparkSession, rows: DataFrame, at: str, order: str, days: int = 5) -> DataFrame:
    """A stream whose batches are some days each, the earliest first; rows without a time come before all.

    The source takes files by the time they were written, so the parts are written one
    after another. A part is as many files as the largest one needs, each of about
    PART_ROWS rows in the order of ``order``; where rows are too few, empty files fill up.
    """
    path, width = new_path(spark, "parts"), days * DAY_US
    # One row for some days.
    sizes = rows.groupBy((F.col(at) - F.pmod(F.col(at), F.lit(width))).alias("start")).count().orderBy(F.asc_nulls_first("start")).collect()
    files = max([1, *(-(-r["count"] // PART_ROWS) for r in sizes)])
    for place, r in enumerate(sizes):
        own = rows.where(F.col(at).isNull() if r["start"] is None else F.col(at).between(r["start"], r["start"] + width - 1))
        folder = f"{path}/part={place}"
        own.repartition(files, order).sortWithinPartitions(order).write.parquet(folder)
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    if not sizes:
        spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/part=0")
    return readers.stream_events(spark, f"{path}/*", rows.schema, files)


def _run(spark: SparkSession, rows: DataFrame, mode: str = "append") -> tuple[str, int]:
    out = new_path(spark, "stream")
    last = streams.run_available(rows, new_path(spark, "progress"), streams.batch_folders(out), mode)
    return out, last


def _upserted(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    out = new_path(spark, "stream")
    last = streams.run_available(rows, new_path(spark, "progress"), streams.upsert_folders(out, keys), "update")
    return spark.read.parquet(f"{out}/batch={last}")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def _event_stream(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The event table as a stream; of the named columns where only those are wanted."""
    return _in_parts(spark, trace(spark, folder).select(*(columns or "*")), "started_us", "sequence")


@add("src5_event_stream", O.events("select sequence, started_us, query from ev"))
def _source(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = _run(spark, _event_stream(spark, folder, "sequence", "started_us", "query"))
    return _read(spark, out)


def _settled(spark: SparkSession, rows: DataFrame, at: str, make) -> settled.Tables:
    """Run a stream through a settling step to its end."""
    tables = settled.Tables(spark, new_path(spark, "settled"))
    sink = settled.Settling(tables, at, 2 * DAY_US, make(tables))
    last = streams.run_available(rows, new_path(spark, "progress"), sink)
    sink.finish(last, rows.schema)
    return tables


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    # What detection and the status read; no query shows another column, and the parts read the table once each.
    read = trace_tx(spark, folder).select("sequence", "started_us", "duration_ms", "connection_id", "tx_id", "operation", "query", "args", "error")
    rows = settled.Enrichment.rows(_in_parts(spark, materialize(read), "started_us", "sequence"), TRACE)
    return _settled(spark, rows, "started_us", lambda tables: settled.Enrichment(tables, TRACE)).all("events")


@add("str1_enrich", O.events(
    f"select sequence, slow, normalized_query, n_plus_1_scope, n_plus_1_hits, n_plus_1_distinct_args, n_plus_1, {O.STATUS} as status from ev"))
def _str1(spark: SparkSession, folder: str) -> DataFrame:
    return _enriched(spark, folder).select("sequence", "slow", "normalized_query", "n_plus_1_scope", "n_plus_1_hits", "n_plus_1_distinct_args", "n_plus_1", "status")


@add("str1_filtered_sink", O.events(f"select sequence, {O.STATUS} as status from ev where n_plus_1 and duration_ms > 50"))
def _str1_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """What a filter line keeps of the streamed events, N+1 included."""
    return _enriched(spark, folder).where(compile_filter("n+1 d>50ms")).select("sequence", "status")


def _nplus1(spark: SparkSession, folder: str) -> DataFrame:
    # What detection reads; the parts read the table once each.
    read = trace_tx(spark, folder).select("sequence", "started_us", "duration_ms", "connection_id", "tx_id", "operation", "query", "args")
    rows = settled.NPlusOne.rows(_in_parts(spark, materialize(read), "started_us", "sequence"), TRACE)
    return _settled(spark, rows, "started_us", lambda tables: settled.NPlusOne(tables, TRACE)).all("hits")


@add("str2_nplus1", O.events("select sequence, n_plus_1_scope, normalized_query, n_plus_1_hits, n_plus_1_distinct_args, n_plus_1 from ev where candidate"))
def _str2(spark: SparkSession, folder: str) -> DataFrame:
    return _nplus1(spark, folder).drop("alert", "started_us")


@add("str2_alerts", O.alerts("select sequence, n_plus_1_scope, normalized_query from alerts"))
def _str2_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return _nplus1(spark, folder).where("alert").select("sequence", "n_plus_1_scope", "normalized_query")


_TTL_US = 6 * 3_600_000_000


# A key is a connection and operation; it is forgotten after six silent hours.
@add("str10_key_lives", O.events(f"""select connection_id, operation, min(started_us) as life_us, max(started_us) as last_us, count(*) as rows from (
    select *, sum(fresh) over (partition by connection_id, operation order by started_us, sequence) as life from (
        select connection_id, operation, sequence, started_us, case when started_us - lag(started_us) over (partition by connection_id, operation order by started_us, sequence) <= {_TTL_US} then 0 else 1 end as fresh
        from ev)) group by connection_id, operation, life"""))
def _str10(spark: SparkSession, folder: str) -> DataFrame:
    steps = []
    rows = _in_parts(spark, materialize(trace_tx(spark, folder)), "started_us", "sequence").select("connection_id", "operation", "started_us")
    _settled(spark, rows, "started_us", lambda tables: steps.append(settled.KeyLives(tables, ["connection_id", "operation"], "connection_id string, operation string", "started_us", _TTL_US)) or steps[0])
    return steps[0].lives()


def _assembled(spark: SparkSession, rows: DataFrame, idle_us: int) -> DataFrame:
    stream = _in_parts(spark, materialize(rows), "captured_us", "frame_no")
    return _settled(spark, stream, "captured_us", lambda tables: settled.Assembly(tables, TRACE, idle_us)).all("events")


# Unfinished requests stay in the state while their connection is not idle.
@add("str3_assembly", O.assembly("select connection_id || '-' || rank as event_id, frame_no, query, arg as args, error, status_tag, rows_affected, "
                                 "(completed_us - captured_us) / 1000.0 as duration_ms from paired where completed"))
def _str3(spark: SparkSession, folder: str) -> DataFrame:
    return _assembled(spark, messages(spark, folder), 40 * DAY_US).select(
        "event_id", "frame_no", "query", F.array_join("args", "|").alias("args"), "error", "status_tag", "rows_affected", "duration_ms")


@add("str4_idle_flush", O.assembly("select connection_id || '-' || rank as event_id, query, error, status_tag from paired where not completed"))
def _str4(spark: SparkSession, folder: str) -> DataFrame:
    """Connections are closed after three silent days; a late marker row moves time on."""
    rows = messages(spark, folder)
    marker = rows.orderBy(F.desc("frame_no")).limit(1).select(*[
        (F.lit("marker") if c == "connection_id" else F.lit("Ready") if c == "kind" else F.col(c) + 10 * DAY_US if c == "captured_us" else F.col(c)).alias(c)
        for c in rows.columns])
    found = _assembled(spark, rows.unionByName(marker), 3 * DAY_US)
    return found.where("status_tag = 'DISCONNECTED'").select("event_id", "query", "error", "status_tag")


_STATS = (f"select normalized_query as query, count(*) as count, cast(sum(cast(round(duration_ms * 1000) as bigint)) as bigint) as total_us, max(duration_ms) as max_duration_ms, "
          "count(*) filter (where error <> '') as error_count, count(*) filter (where slow) as slow_count, count(*) filter (where n_plus_1) as n_plus_1_count, "
          "cast(sum(rows_affected) as bigint) as total_rows, cast(sum(response_total_bytes) as bigint) as total_response_bytes from ev group by 1")


@add("str5_template_metrics", O.events(_STATS))
def _str5(spark: SparkSession, folder: str) -> DataFrame:
    return _upserted(spark, streams.stream_analytics(_event_stream(spark, folder)), ["query"])


@add("str6_counters", O.events(
    "select count(*) as total_captured, count(*) filter (where error <> '') as error_count, count(*) filter (where slow) as slow_count, "
    "count(*) filter (where n_plus_1) as nplus1_count from ev"))
def _str6(spark: SparkSession, folder: str) -> DataFrame:
    out, last = _run(spark, streams.stream_counters(_event_stream(spark, folder)), "complete")
    return spark.read.parquet(f"{out}/batch={last}")


@add("str7_top_events", O.events(f"select * from ({_SNAPSHOT} where slow) order by duration_ms desc, sequence desc limit 10"))
def _str7(spark: SparkSession, folder: str) -> DataFrame:
    out = new_path(spark, "top")
    last = streams.run_available(_event_stream(spark, folder), new_path(spark, "progress"), streams.top_events_sink(out, "slow", 10))
    return spark.read.parquet(f"{out}/batch={last}")


@add("str8_bursts", O.events("""select started_us // 3600000000 * 3600000000 as window_start_us, (started_us // 3600000000 + 1) * 3600000000 as window_end_us,
    count(*) as events, count(*) filter (where error <> '') as errors from ev group by 1, 2"""))
def _str8(spark: SparkSession, folder: str) -> DataFrame:
    """Update mode shows every window, also the ones the watermark has not closed."""
    return _upserted(spark, streams.stream_bursts(_event_stream(spark, folder), LATE), ["window_start_us", "window_end_us"])


# Sessions that the watermark has closed.
@add("str9_sessions", O.events(f"""select connection_id, min(started_us) as session_start_us, max(started_us) + 7200000000 as session_end_us, count(*) as events from (
    select *, sum(fresh) over (partition by connection_id order by started_us, sequence) as session from (
        select connection_id, sequence, started_us, case when started_us - lag(started_us) over (partition by connection_id order by started_us, sequence) < 7200000000 then 0 else 1 end as fresh from ev))
    group by connection_id, session having max(started_us) + 7200000000 < (select max(started_us) // 1000 * 1000 from ev) - {2 * 86_400_000_000}"""))
def _str9(spark: SparkSession, folder: str) -> DataFrame:
    out, _ = _run(spark, streams.stream_sessions(_event_stream(spark, folder), LATE, "2 hours"))
    return _read(spark, out)


def _fan_out(spark: SparkSession, folder: str) -> DataFrame:
    """Every batch goes to two sinks with different filters; shown is what each one holds."""
    slow, failed = new_path(spark, "slow"), new_path(spark, "failed")
    both = sinks.fan_out([sinks.jsonl_sink(slow, filter_line="slow"), sinks.jsonl_sink(failed, filter_line="error")])
    streams.run_available(_event_stream(spark, folder), new_path(spark, "progress"), both)
    found = [readers.read_events(spark, f"{path}/batch=*", "jsonl").select(F.lit(name).alias("sink"), "time", "query")
             for name, path in (("slow", slow), ("error", failed))]
    return found[0].unionByName(found[1])


QUERIES["snk12_fan_out"] = (_fan_out, O.events(
    f"select 'slow' as sink, {O.iso('started_us')} as time, query from ev where slow union all "
    f"select 'error', {O.iso('started_us')}, query from ev where error <> ''"))


@add("udf1_custom_sink", O.events("select operation, count(*) as n from ev where contains(lower(query), 'clicks') group by 1"))
def _custom(spark: SparkSession, folder: str) -> DataFrame:
    """A sink of the user's own: any function of a batch and its number."""
    path = new_path(spark, "custom")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.where(compile_filter("query:clicks")).groupBy("operation").count().write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    streams.run_available(_event_stream(spark, folder), new_path(spark, "progress"), sinks.fan_out([keep]))
    return _read(spark, path).groupBy("operation").agg(F.sum("count").alias("n"))
