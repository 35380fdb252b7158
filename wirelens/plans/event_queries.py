"""Registered queries over query events: name -> (Spark query, DuckDB answer)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.filters import compile_filter, matches_search
from ..operators import analytics, compare, enrich, ranking, timeline, transactions
from . import oracle as O
from .fixtures import TRACE, fresh_trace, raw_trace, trace, trace_tx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def add(name: str, answer: str | None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = (query, answer)
        return query

    return keep


def over(name: str, answer: str | None, make: Callable[[DataFrame], DataFrame], source: Query = trace) -> None:
    QUERIES[name] = (lambda spark, folder: make(source(spark, folder)), answer)


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.nplus1_alerts(trace(spark, folder), TRACE)


# --- transactions and enrichment ------------------------------------------------------

over("asm13_transactions", O.events("select sequence, connection_id, operation, tx_id from assigned"),
     lambda d: d.select("sequence", "connection_id", "operation", "tx_id"), trace_tx)
over("enr1_slow", O.events("select sequence, slow from ev"),
     lambda d: d.select("sequence", enrich.slow_flag(F.col("duration_ms"), 100.0).alias("slow")), raw_trace)
over("enr2_template", O.events("select sequence, normalized_query from ev"),
     lambda d: d.select("sequence", text.normalize_sql(F.col("query")).alias("normalized_query")), raw_trace)
over("enr3_candidate", O.events("select sequence, candidate from ev"),
     lambda d: d.select("sequence", text.is_nplus1_candidate(F.col("operation"), F.col("query")).alias("candidate")), trace_tx)
over("enr4_scope_signature", O.events("select sequence, n_plus_1_scope, sig as signature from ev where candidate"),
     lambda d: enrich.candidates(enrich.add_basics(d, TRACE)).select("sequence", "n_plus_1_scope", "signature"), trace_tx)
over("enr5_hits", O.events("select sequence, n_plus_1_hits from ev"),
     lambda d: d.select("sequence", "n_plus_1_hits"), fresh_trace)
over("enr6_distinct_args", O.events("select sequence, n_plus_1_distinct_args from ev"),
     lambda d: d.select("sequence", "n_plus_1_distinct_args"), fresh_trace)
over("enr7_match", O.events("select sequence, n_plus_1, n_plus_1_scope, n_plus_1_hits, n_plus_1_distinct_args from ev"),
     lambda d: d.select("sequence", "n_plus_1", "n_plus_1_scope", "n_plus_1_hits", "n_plus_1_distinct_args"), fresh_trace)
over("enr8_alerts", O.alerts("select sequence, n_plus_1_scope, normalized_query, started_us from alerts"),
     lambda d: d.select("sequence", "n_plus_1_scope", "normalized_query", "started_us"), _alerts)
over("enr9_notices", O.alerts(f"select sequence, {O.NOTICE} as notice from alerts"),
     lambda d: d.select("sequence", "notice"), _alerts)
over("enr10_status", O.events(f"select sequence, {O.STATUS} as status from ev"),
     lambda d: d.select("sequence", text.event_status().alias("status")))
over("enr11_markers", O.events(
    "select sequence, case when error <> '' or n_plus_1 or slow then concat_ws(',', case when error <> '' then 'ERROR' end, "
    "case when n_plus_1 then 'N+1[' || n_plus_1_hits || '/' || n_plus_1_distinct_args || ']' end, case when slow then 'SLOW' end) "
    "when status_tag <> '' then status_tag else 'OK' end as markers from ev"),
     lambda d: d.select("sequence", text.event_markers().alias("markers")))

# --- filters: one boolean column per filter line ---------------------------------------

_HAY = ("lower(concat_ws(' ', nullif(query, ''), nullif(array_to_string(args, ' '), ''), nullif(error, ''), "
        "nullif(normalized_query, ''), nullif(connection_id, ''), nullif(tx_id, ''), nullif(status_tag, ''), "
        "nullif(array_to_string(response_columns, ' '), '')))")


def _has(c: str, v: str) -> str:
    return f"contains(lower({c}), '{v}')"


def _hay(v: str) -> str:
    return f"contains({_HAY}, '{v}')"


def _tab(v: str) -> str:
    padded = "' ' || lower(normalized_query) || ' '"
    return "(" + " or ".join(f"contains({padded}, ' {w} {v} ')" for w in ("from", "join", "update")) + ")"


_SCOPE = "case when n_plus_1_scope <> '' then n_plus_1_scope else connection_id end"
_FLAG = "(error <> '' or slow or n_plus_1)"

FILTERS: dict[str, list[tuple[str, str]]] = {
    "fil1_grammar": [
        ("slow or error and not op:exec", "slow or (error <> '' and not lower(operation) = 'exec')"),
        ("slow error", "slow and error <> ''"),
        ("not (slow or n+1) rows>0", "not (slow or n_plus_1) and rows_affected > 0"),
        ("(slow or error", "slow or error <> ''"),
        ("slow ) clicks or k1", f"slow and {_hay(') clicks or k1')}"),
        ("\"or\" slow", f"{_hay('or')} and slow"),
        ("not not slow", "slow"),
        ("", "true"),
    ],
    "fil2_evaluation": [
        ("table:users or table:orders or error or slow or nplus1", f"{_tab('users')} or {_tab('orders')} or {_FLAG}"),
        ("(error or slow or nplus1) and not op:begin and not op:commit",
         f"{_FLAG} and not lower(operation) = 'begin' and not lower(operation) = 'commit'"),
        ("table:users or table:orders or slow or error or nplus1", f"{_tab('users')} or {_tab('orders')} or {_FLAG}"),
        ("op:select and d>50ms and not error",
         "starts_with(lower(trim(query)), 'select') and duration_ms / 1000.0 > 0.05 and error = ''"),
        ("(table:users or table:orders) and rows>0", f"({_tab('users')} or {_tab('orders')}) and rows_affected > 0"),
        ("n+1 and scope:conn and not slow", f"n_plus_1 and {_has(_SCOPE, 'conn')} and not slow"),
    ],
    "fil3_duration": [
        ("d>100ms", "duration_ms / 1000.0 > 0.1"), ("duration<=1s", "duration_ms / 1000.0 <= 1"),
        ("dur>=250000us", "duration_ms / 1000.0 >= 0.25"), ("D<0.001m", "duration_ms / 1000.0 < 0.06"),
        ("d!=5ms", "duration_ms / 1000.0 <> 0.005"), ("d:6.55ms", "duration_ms / 1000.0 = 6.55 / 1000.0"),
        ("d>100", "duration_ms > 0"), ("not d>100ms", "not duration_ms / 1000.0 > 0.1"),
    ],
    "fil4_rows": [
        ("rows>=3", "rows_affected >= 3"), ("row:2", "rows_affected = 2"), ("rows!=+1", "rows_affected <> 1"),
        ("rows>-1.5", "rows_affected > -1.5"), ("rows<many", "rows_affected < 0"),
    ],
    "fil5_flags": [("error", "error <> ''"), ("slow", "slow"), ("n+1", "n_plus_1"), ("NPLUS1", "n_plus_1"), ("slow:no", "slow")],
    "fil6_transaction": [("tx", "tx_id <> ''"), ("notx", "tx_id = ''")],
    "fil7_operation": [
        ("op:query", "lower(operation) = 'query'"), ("op:EXECUTE", "lower(operation) = 'execute'"),
        ("op:insert", "starts_with(lower(trim(query)), 'insert')"), ("op!=select", "not starts_with(lower(trim(query)), 'select')"),
        ("op:show", "false"), ("op!=show", "true"),
    ],
    "fil8_query": [("query:clicks", _has("query", "clicks")), ("sql!=items", f"not {_has('query', 'items')}"), ("query>Users", _has("query", "users"))],
    "fil9_normalized": [("norm:?", _has("normalized_query", "?")), ("normalized!=\"in (?\"", f"not {_has('normalized_query', 'in (?')}")],
    "fil10_args": [
        ("arg:7", "len([a for a in args if contains(lower(a), '7')]) > 0"),
        ("args!=7", "len([a for a in args if not contains(lower(a), '7')]) > 0"),
    ],
    "fil11_error_text": [("err:missing", _has("error", "missing")), ("error!=missing", f"not {_has('error', 'missing')}")],
    "fil12_status": [("status:slow", _has(O.STATUS, "slow")), ("status:n+1", _has(O.STATUS, "n+1")), ("status!=ok", f"not {_has(O.STATUS, 'ok')}")],
    "fil13_connection": [("conn:c1", _has("connection_id", "c1")), ("connection!=c1", f"not {_has('connection_id', 'c1')}")],
    "fil14_scope": [("scope:c1:", _has(_SCOPE, "c1:")), ("scope:tx", _has(_SCOPE, "tx"))],
    "fil15_transaction_id": [("tx:c2:", _has("tx_id", "c2:")), ("transaction!=c2", f"not {_has('tx_id', 'c2')}")],
    "fil16_columns": [
        ("col:nam", "len([a for a in response_columns if contains(lower(a), 'nam')]) > 0"),
        ("column!=id", "len([a for a in response_columns if not contains(lower(a), 'id')]) > 0"),
    ],
    "fil17_table": [("table:clicks", _tab("clicks")), ("table!=items", f"not {_tab('items')}"), ("table:orders2", _tab("orders2"))],
    "fil18_bare_word": [("K12", _hay("k12")), ("name", _hay("name")), ("\"c3 \"", _hay("c3 "))],
    "fil19_unknown_field": [("host:c1", _hay("c1")), ("host!=c1", f"not {_hay('c1')}")],
}


def _add_filters(name: str, cases: list[tuple[str, str]]) -> None:
    flags = {f"line_{i}": case for i, case in enumerate(cases, 1)}
    answer = O.events("select sequence, " + ", ".join(f"{sql} as {c}" for c, (_, sql) in flags.items()) + " from ev")
    over(name, answer, lambda d: d.select("sequence", *[compile_filter(line).alias(c) for c, (line, _) in flags.items()]))


for _name, _cases in FILTERS.items():
    _add_filters(_name, _cases)

_FREE = "lower(concat_ws(' ', query, array_to_string(args, ' '), error, normalized_query, array_to_string(response_columns, ' ')))"
over("fil20_search", O.events(f"select sequence from ev where slow and contains({_FREE}, 'in (1,2')"),
     lambda d: d.where(compile_filter("slow") & matches_search("IN (1,2")).select("sequence"))
over("fil21_no_tx_control", O.events(
    "select sequence from ev where operation not in ('BEGIN','COMMIT','ROLLBACK') and normalized_query <> ''"),
     lambda d: analytics.drop_tx_control(d).select("sequence"))

# --- joins -----------------------------------------------------------------------------

_SHOWN = "case when query <> '' then query else operation end"
over("joi1_tx_context", O.events(
    f"select tx_id, sequence, operation, duration_ms, {O.STATUS} as status, {O.compact(_SHOWN, 140)} as query from ev "
    "where tx_id <> '' and tx_id in (select tx_id from ev where error <> '')"),
     lambda d: transactions.tx_context(d, d.where("error <> ''"), TRACE.block_rows))

_TX = f"""select tx_id, min(connection_id) as connection_id, min(started_us) as started_us, max({O.END_US}) as finished_us,
    cast(sum(rows_affected) as bigint) as rows_affected, count(*) as event_count, count(*) filter (where error <> '') as error_count,
    count(*) filter (where slow) as slow_count, count(*) filter (where n_plus_1) as n_plus_1_count, min(sequence) as first_sequence,
    greatest((max({O.END_US}) - min(started_us)) / 1000.0, 0) as duration_ms,
    {O.compact("string_agg(query, '; ' order by sequence)", 120)} as query_preview from ev where tx_id <> '' group by tx_id"""
over("joi2_tx_summary_join", O.events(
    f"select sequence, e.tx_id, t.event_count as tx_event_count, t.duration_ms as tx_duration_ms, t.query_preview as tx_query_preview "
    f"from ev e left join ({_TX}) t using (tx_id)"),
     lambda d: transactions.with_tx_summary(d, TRACE.block_rows).select(
         "sequence", "tx_id", "tx_event_count", "tx_duration_ms", "tx_query_preview"))
_EXTENT = f"(select min(started_us) as lo, max({O.END_US}) as hi, greatest(max({O.END_US}) - min(started_us), 1000) as span from ev)"
over("joi3_extent", O.events(f"select sequence, lo as min_us, hi as max_us, span as span_us from ev, {_EXTENT}"),
     lambda d: timeline.with_extent(d).select("sequence", "min_us", "max_us", "span_us"))

_SPLIT = 1705363200000000  # 2024-01-16 in microseconds
_RUN = (f"select normalized_query as query, count(*) as n, {O.TOTAL_MS} as total, {O.TOTAL_MS} / count(*) as av, "
        "count(*) filter (where error <> '') as er, count(*) filter (where slow) as sl, count(*) filter (where n_plus_1) as np from ev "
        "where operation not in ('BEGIN','COMMIT','ROLLBACK') and normalized_query <> '' and started_us {op} " + str(_SPLIT) + " group by 1")
_NAMES = {"n": "count", "total": "total_duration_ms", "av": "avg_duration_ms", "er": "error_count", "sl": "slow_count", "np": "n_plus_1_count"}
_COMPARED = (f"select coalesce(b.query, a.query) as query, " + ", ".join(
    f"coalesce(b.{k}, 0) as {v}_before, coalesce(a.{k}, 0) as {v}_after, coalesce(a.{k}, 0) - coalesce(b.{k}, 0) as {v}_change"
    for k, v in _NAMES.items()) + f" from ({_RUN.format(op='<')}) b full join ({_RUN.format(op='>=')}) a on b.query = a.query")
over("joi5_compare_runs", O.events(_COMPARED),
     lambda d: compare.compare_runs(d.where(F.col("started_us") < _SPLIT), d.where(F.col("started_us") >= _SPLIT)))
over("gat1_violations", O.events(
    "select query, count_before, count_after, rule from ("
    f"select *, unnest([x for x in [case when n_plus_1_count_after > 0 then 'n_plus_1' end, case when slow_count_after > 0 then 'slow' end, "
    f"case when count_before > 0 and count_after > count_before * 1.02 then 'count_growth' end] if x is not null]) as rule from ({_COMPARED}))"),
     lambda d: compare.violations(d.where(F.col("started_us") < _SPLIT), d.where(F.col("started_us") >= _SPLIT), 0.02))

# --- aggregations ------------------------------------------------------------------------


def _stats(key: str, where: str, sample: str) -> str:
    return f"""select {key} as query, {sample} as sample_query, count(*) as count, {O.TOTAL_MS} as total_duration_ms,
    {O.TOTAL_MS} / count(*) as avg_duration_ms,
    list_sort(list(duration_ms))[cast(floor((count(*) - 1) * 0.95::double) as bigint) + 1] as p95_duration_ms,
    max(duration_ms) as max_duration_ms, cast(sum(rows_affected) as bigint) as total_rows,
    count(*) filter (where error <> '') as error_count, count(*) filter (where slow) as slow_count,
    count(*) filter (where n_plus_1) as n_plus_1_count, count(distinct connection_id) as connection_count,
    count(distinct nullif(tx_id, '')) as transaction_count from ev where {where} group by 1"""


_PLAIN = "operation not in ('BEGIN','COMMIT','ROLLBACK') and normalized_query <> ''"
_ANALYTICS = _stats("normalized_query", _PLAIN, "min_by(query, sequence)")
over("agg1_analytics", O.events(_ANALYTICS), analytics.analytics)
over("agg2_p95", O.events(f"select query as normalized_query, p95_duration_ms from ({_ANALYTICS})"),
     lambda d: analytics.lower_percentile(analytics.drop_tx_control(d), ["normalized_query"], "duration_ms", 0.95, "p95_duration_ms"))
over("agg3_sample_slowest", O.events(
    f"select normalized_query, arg_max(query, (duration_ms, -sequence)) as sample_query from ev where {_PLAIN} group by 1"),
     lambda d: analytics.sample_queries(analytics.drop_tx_control(d), "duration"))
over("agg4_export_analytics", O.events(
    "select query, count, total_duration_ms as total_ms, avg_duration_ms as avg_ms, p95_duration_ms as p95_ms, max_duration_ms as max_ms, "
    "total_rows as rows_total, error_count as errors, slow_count as slow, n_plus_1_count as n_plus_1 from ("
    + _stats("normalized_query", "normalized_query <> ''", "''") + ")"), analytics.export_analytics)
over("agg5_tx_summary", O.events(_TX), transactions.tx_summary)
_TX_EXPORT = (f"select tx_id, connection_id, event_count, rows_affected, error_count, slow_count, n_plus_1_count, "
              f"{O.iso('started_us')} as started_at, {O.iso('finished_us')} as finished_at, duration_ms from ({{tx}})")
over("agg6_export_transactions", O.events(_TX_EXPORT.format(tx=_TX.replace("where tx_id <> ''", "where tx_id <> '' and slow"))),
     lambda d: transactions.export_transactions(d.where("slow")))
_TOTALS = ("count(*) as events, count(*) filter (where error <> '') as errors, count(*) filter (where slow) as slow, "
           f"count(*) filter (where n_plus_1) as n_plus_1, round({O.TOTAL_MS}, 3) as total_duration_ms, "
           "cast(sum(rows_affected) as bigint) as total_rows, cast(sum(response_total_bytes) as bigint) as total_response_bytes")
over("agg7_report_totals", O.events(f"select {_TOTALS} from ev"), analytics.report_totals)
over("agg8_operations", O.events("select case when operation = '' then 'Unknown' else operation end as operation, count(*) as count from ev group by 1"),
     analytics.operation_histogram)
_KEY = "case when normalized_query <> '' then normalized_query else '(empty query)' end"
_QUERY_STATS = f"""select {_KEY} as query, min_by(query, sequence) as sample_query, count(*) as count, round({O.TOTAL_MS}, 3) as total_duration_ms,
    round({O.TOTAL_MS} / count(*), 3) as avg_duration_ms, round(max(duration_ms), 3) as max_duration_ms,
    count(*) filter (where error <> '') as error_count, count(*) filter (where slow) as slow_count,
    count(*) filter (where n_plus_1) as n_plus_1_count, cast(sum(rows_affected) as bigint) as total_rows,
    cast(sum(response_total_bytes) as bigint) as total_response_bytes, min(sequence) as first_sequence from ev group by 1"""
over("agg9_query_stats", O.events(f"select * exclude (first_sequence) from ({_QUERY_STATS})"), analytics.report_query_stats)
over("agg10_rollup", O.events(
    f"select case grouping(operation, normalized_query) when 3 then 'total' when 1 then 'operation' else 'query' end as level, "
    f"coalesce(operation, normalized_query, '') as name, count(*) as count, round({O.TOTAL_MS}, 3) as total_duration_ms, "
    "max(duration_ms) as max_duration_ms, cast(sum(rows_affected) as bigint) as total_rows, count(*) filter (where error <> '') as error_count, "
    "count(*) filter (where slow) as slow_count, count(*) filter (where n_plus_1) as n_plus_1_count, "
    "cast(sum(response_total_bytes) as bigint) as total_response_bytes from ev group by grouping sets ((), (operation), (normalized_query))"),
     analytics.report_rollup)
over("agg11_counters", O.events(
    "select count(*) as total_captured, count(*) filter (where error <> '') as error_count, count(*) filter (where slow) as slow_count, "
    "count(*) filter (where n_plus_1) as nplus1_count from ev"), analytics.counters)

# --- timeline ----------------------------------------------------------------------------

over("win1_query_timeline", O.events(
    f"select 'event' as kind, {_SHOWN} as label, started_us, duration_ms, 'seq=' || sequence || ' op=' || operation || ' conn=' || connection_id "
    f"|| ' tx=' || case when tx_id <> '' then tx_id else '-' end || ' dur=' || {O.fixed('duration_ms', 2)} || 'ms rows=' || rows_affected "
    f"|| ' status=' || ({O.STATUS}) as summary, tx_id, error <> '' as error, slow, n_plus_1, sequence from ev "
    "where operation not in ('BEGIN','COMMIT','ROLLBACK')"), timeline.query_timeline)
over("win2_tx_timeline", O.events(
    "select 'tx' as kind, 'tx ' || left(tx_id, 8) || ' (' || event_count || ' stmt)' as label, started_us, duration_ms, "
    "'tx=' || tx_id || ' conn=' || connection_id || ' events=' || event_count || ' rows=' || rows_affected || ' errors=' || error_count "
    "|| ' slow=' || slow_count || ' n+1=' || n_plus_1_count || ' preview=' || query_preview as summary, tx_id, error_count > 0 as error, "
    f"slow_count > 0 as slow, n_plus_1_count > 0 as n_plus_1, first_sequence as sequence from ({_TX})"), timeline.tx_timeline)
_BINS = (f"select sequence, cast(floor((started_us - lo) / span::double * 59) as bigint) as bin_start, "
         f"greatest(1, cast(ceil(duration_ms * 1000.0 / span::double * 60) as bigint)) as width from ev, {_EXTENT}")
_PLACED = f"select sequence, bin_start, greatest(bin_start + 1, least(60, bin_start + width)) as bin_end from ({_BINS})"
over("win3_bin_places", O.events(_PLACED), lambda d: timeline.place_on_bins(d, 60).select("sequence", "bin_start", "bin_end"))
over("win3_time_bins", O.events(
    f"select b.bin, count(p.sequence) as active from (select unnest(range(60)) as bin) b left join ({_PLACED}) p "
    "on p.bin_start <= b.bin and b.bin < p.bin_end group by 1"), lambda d: timeline.time_bins(d, 60))
over("win4_grouped_list", O.events(
    f"select 'tx' as kind, first_sequence as group_key, first_sequence as sequence, tx_id, query_preview as query, duration_ms, event_count from ({_TX}) "
    f"union all select 'event', case when tx_id <> '' then min(sequence) over (partition by tx_id) else sequence end, sequence, tx_id, "
    f"{O.compact('query', 120)}, duration_ms, 1 from ev"), lambda d: timeline.grouped_list(d, TRACE.block_rows))
over("win5_rank", O.events("select sequence, duration_ms, row_number() over (order by duration_ms desc, sequence) as rank from ev qualify rank <= 25"),
     lambda d: timeline.ranked(d, [F.desc("duration_ms"), F.col("sequence")], 25).select("sequence", "duration_ms", F.col("rank").cast("bigint").alias("rank")))
over("win6_concurrency", O.events(
    f"select connection_id, cast(max(level) as bigint) as peak from (select connection_id, sum(step) over (partition by connection_id order by moment, kind) as level from ("
    f"select connection_id, started_us as moment, 0 as kind, 1 as step from ev union all select connection_id, {O.END_US}, 1, -1 from ev)) group by 1"),
     lambda d: timeline.concurrency(d, "connection_id", TRACE.block_us))
over("win6_tx_overlap", O.events(
    f"select connection_id, cast(max(level) as bigint) as peak from (select connection_id, sum(step) over (partition by connection_id order by moment, kind) as level from ("
    f"select connection_id, started_us as moment, 0 as kind, 1 as step from ({_TX}) union all "
    f"select connection_id, started_us + cast(round(duration_ms * 1000) as bigint), 1, -1 from ({_TX}))) group by 1"),
     lambda d: timeline.concurrency(transactions.tx_measures(d), "connection_id", TRACE.block_us))
_BURST = "count(*) as events, count(*) filter (where error <> '') as errors, count(*) filter (where slow) as slow"
_HOUR = 3_600_000_000
over("win7_bursts_tumbling", O.events(
    f"select started_us // {_HOUR} * {_HOUR} as window_start_us, (started_us // {_HOUR} + 1) * {_HOUR} as window_end_us, {_BURST} from ev group by 1, 2"),
     lambda d: timeline.bursts(d, "1 hour"))
over("win7_bursts_sliding", O.events(
    f"select s as window_start_us, s + {_HOUR} as window_end_us, {_BURST} from ("
    f"select *, unnest([started_us // {_HOUR // 2} * {_HOUR // 2}, started_us // {_HOUR // 2} * {_HOUR // 2} - {_HOUR // 2}]) as s from ev) group by 1, 2"),
     lambda d: timeline.bursts(d, "1 hour", "30 minutes"))

# --- orders and top-k ----------------------------------------------------------------------

over("top1_by_time", O.events("select sequence, duration_ms from ev order by sequence"),
     lambda d: ranking.list_order(d, "time").select("sequence", "duration_ms"))
over("top2_by_duration", O.events("select sequence, duration_ms from ev order by duration_ms desc, sequence"),
     lambda d: ranking.list_order(d, "duration").select("sequence", "duration_ms"))
for _mode in ranking.ANALYTICS_MODES:
    over(f"top3_analytics_{_mode}", O.events(_ANALYTICS),
         lambda d, mode=_mode: ranking.analytics_order(analytics.analytics(d, "time"), mode))
_TOPQ = {
    "slow": ("top4_slow_templates", "slow_count", "slow_count desc, total_duration_ms desc, max_duration_ms desc, count desc"),
    "n_plus_1": ("top5_nplus1_templates", "n_plus_1_count", "n_plus_1_count desc, count desc, total_duration_ms desc"),
    "errors": ("top6_error_templates", "error_count", "error_count desc, count desc, total_duration_ms desc"),
}
for _kind, (_name, _figure, _order) in _TOPQ.items():
    over(_name, O.events(f"select * exclude (sample_query) from ({_QUERY_STATS}) where {_figure} > 0 order by {_order}, first_sequence limit 10"),
         lambda d, kind=_kind: ranking.top_queries(analytics.report_base(d), kind, 10))
_SNAPSHOT = f"""select sequence, {O.iso('started_us')} as time, connection_id, tx_id, operation, {O.SHOWN} as status, round(duration_ms, 3) as duration_ms,
    rows_affected, response_total_rows as response_rows, response_total_bytes as response_bytes, error, slow, n_plus_1, n_plus_1_hits,
    n_plus_1_distinct_args, {O.compact('query', 300)} as query from ev"""
_TOPE = {
    "slow": ("top7_slow_events", "slow", "duration_ms desc"), "n_plus_1": ("top8_nplus1_events", "n_plus_1", "n_plus_1_hits desc, duration_ms desc"),
    "errors": ("top9_error_events", "error <> ''", "duration_ms desc"),
}
for _kind, (_name, _where, _order) in _TOPE.items():
    over(_name, O.events(f"select * from ({_SNAPSHOT} where {_where}) order by {_order}, sequence desc limit 10"),
         lambda d, kind=_kind: ranking.top_events(d, kind, 10))
over("top10_last_events", O.events("select sequence, query from ev order by sequence desc limit 1000"),
     lambda d: ranking.last_events(d, TRACE.max_events).select("sequence", "query"))
over("top11_last_notices", O.alerts(f"select sequence, {O.NOTICE} as notice from alerts order by sequence desc limit 20"),
     lambda d: ranking.last_notices(d, TRACE.max_notices), _alerts)

# --- scalars over events ---------------------------------------------------------------------

over("sca4_bind_preview", O.events(
    "select sequence, case when len(args) > 0 then replace(query, '$1', '''' || args[1] || '''') else query end as bound from ev"),
     lambda d: d.select("sequence", text.bind_preview(F.col("query"), F.col("args")).alias("bound")))


def _script(analyze: bool) -> Callable[[DataFrame], DataFrame]:
    def make(d: DataFrame) -> DataFrame:
        name = F.concat(F.lit("explain_"), F.col("event_id"))
        script = text.explain_script(F.col("query"), F.col("args"), name, analyze)
        return d.select("sequence", F.array_join(script, "; ").alias("script"))

    return make


for _analyze, _prefix in ((False, "EXPLAIN "), (True, "EXPLAIN ANALYZE ")):
    over(f"sca6_explain_script{'_analyze' if _analyze else ''}", O.events(
        f"select sequence, case when contains(query, '$1') then 'PREPARE explain_' || event_id || ' AS ' || query || '; {_prefix}EXECUTE explain_' || event_id "
        f"|| ' (''' || args[1] || '''); DEALLOCATE explain_' || event_id else '{_prefix}' || query end as script from ev"), _script(_analyze))
over("sca7_format_ms", O.events(f"select sequence, {O.format_ms('duration_ms')} as shown from ev"),
     lambda d: d.select("sequence", text.format_ms(F.col("duration_ms")).alias("shown")))
over("sca8_times", O.events(f"select sequence, {O.iso('started_us')} as iso, strftime(make_timestamp(started_us), '%H:%M:%S') as clock from ev"),
     lambda d: d.select("sequence", text.iso_time(F.col("started_us")).alias("iso"), text.clock_time(F.col("started_us")).alias("clock")))
_MARKERS = ("case when error <> '' or n_plus_1 or slow then concat_ws(',', case when error <> '' then 'ERROR' end, "
            "case when n_plus_1 then 'N+1[' || n_plus_1_hits || '/' || n_plus_1_distinct_args || ']' end, case when slow then 'SLOW' end) "
            "when status_tag <> '' then status_tag else 'OK' end")
over("sca11_event_line", O.events(
    f"select sequence, '[' || strftime(make_timestamp(started_us), '%H:%M:%S') || '] ' || rpad(operation, 8, ' ') || ' ' || lpad({O.fixed('duration_ms', 2)}, 8, ' ') "
    f"|| ' ms rows=' || rpad(rows_affected::varchar, 5, ' ') || ' resp_rows=' || rpad(response_total_rows::varchar, 5, ' ') || ' resp_bytes=' "
    f"|| rpad(response_total_bytes::varchar, 7, ' ') || ' conn=' || connection_id || ' status=' || {_MARKERS} || ' query=' || ({O.compact('query', 120)}) as line from ev"),
     lambda d: d.select("sequence", text.event_line().alias("line")))
over("sca11_response_lines", O.events(
    "select sequence, 'response_size: rows=' || response_total_rows || ' bytes=' || response_total_bytes "
    "|| case when len(response_columns) > 0 then ' / columns: ' || array_to_string(response_columns, ' | ') else '' end "
    "|| case when len(response_rows) > 0 then ' / row 1: ' || array_to_string(response_rows[1], ' | ') else ' / rows: (no preview rows)' end "
    "|| case when response_total_rows > 0 then ' / preview: ' || len(response_rows) || ' of ' || response_total_rows || "
    "case when response_truncated then ' [truncated]' else '' end else '' end as lines from ev"),
     lambda d: d.select("sequence", F.array_join(text.response_lines(), " / ").alias("lines")))
