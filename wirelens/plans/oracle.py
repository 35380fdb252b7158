"""Shared SQL of the reference answers (DuckDB), kept independent of the Spark plans."""

from __future__ import annotations

from .fixtures import TRACE, connections_sql, messages_sql, trace_sql

WINDOW_US, COOLDOWN_US = TRACE.window_us, TRACE.cooldown_us

_EDGE = r"[\s,()=<>+\-*/;]"


def norm(sql: str) -> str:
    number = rf"(^|{_EDGE})[0-9][0-9.]*($|{_EDGE})"
    literal = f"regexp_replace({sql}, '''(?:[^'']|'''')*''?', '''?''', 'g')"
    once = f"regexp_replace({literal}, '{number}', '\\1?\\2', 'g')"
    twice = f"regexp_replace({once}, '{number}', '\\1?\\2', 'g')"
    return f"trim(regexp_replace({twice}, '\\s+', ' ', 'g'))"


def compact(sql: str, n: int) -> str:
    line = f"trim(regexp_replace({sql}, '[\\x00-\\x1f\\x7f\\s]+', ' ', 'g'))"
    return f"case when length({line}) <= {n} then {line} else left({line}, {n - 3}) || '...' end"


def truncate(sql: str, n: int) -> str:
    return f"case when length({sql}) <= {n} then {sql} else left({sql}, {n - 15}) || '... [truncated]' end"


def iso(us: str) -> str:
    return (f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || case when {us} % 1000000 = 0 then '' "
            f"else '.' || lpad(cast({us} % 1000000 as varchar), 6, '0') end || '+00:00'")


def fixed(sql: str, places: int) -> str:
    """Decimal text, half up."""
    return f"cast(round(cast({sql} as decimal(30,6)), {places}) as decimal(30,{places}))::varchar"


def format_ms(sql: str) -> str:
    return (f"case when {sql} < 1 then cast(round(cast({sql} as decimal(30,6)) * 1000) as bigint)::varchar || 'us' "
            f"when {sql} < 1000 then {fixed(sql, 1)} || 'ms' else {fixed(f'{sql} / 1000', 2)} || 's' end")


STATUS = ("case when error <> '' then 'ERROR' when n_plus_1 and slow then 'N+1+S(' || n_plus_1_hits || ')' "
          "when n_plus_1 then 'N+1(' || n_plus_1_hits || ')' when slow then 'SLOW' else 'OK' end")
SHOWN = f"case when status_tag <> '' then status_tag else {STATUS} end"
END_US = "started_us + cast(round(duration_ms * 1000) as bigint)"
TOTAL_MS = "cast(sum(cast(round(duration_ms * 1000) as bigint)) as bigint) / 1000.0"

_EVENTS = f"""
raw as ({trace_sql('duckdb')}),
marked as (select *, case when upper(trim(query)) like 'BEGIN%' then 'BEGIN' when upper(trim(query)) like 'COMMIT%' then 'COMMIT'
    when upper(trim(query)) like 'ROLLBACK%' then 'ROLLBACK' end as ctl from raw),
running as (select *,
    count(*) filter (where ctl = 'BEGIN') over (partition by connection_id order by sequence) as begins,
    last_value(ctl ignore nulls) over (partition by connection_id order by sequence
      rows between unbounded preceding and 1 preceding) as last_ctl from marked),
assigned as (select * exclude (operation, ctl, begins, last_ctl), coalesce(ctl, operation) as operation,
    case when ctl = 'BEGIN' or last_ctl = 'BEGIN' then connection_id || ':' || begins else '' end as tx_id from running),
basics as (select *, 'e' || sequence as event_id, {norm('query')} as normalized_query, duration_ms >= 100 as slow,
    operation in ('Query','Exec','Execute') and (upper(trim(query)) like 'SELECT%' or upper(trim(query)) like 'WITH%')
      and contains(' ' || upper(trim(query)) || ' ', ' FROM ') as candidate,
    case when tx_id <> '' then tx_id else connection_id end as scope,
    case when len(args) > 0 then array_to_string(args, '|') else query end as sig,
    [r for r in first_rows if len(r) > 0] as response_rows, response_total_rows > 1 as response_truncated from assigned),
hits as (select a.sequence, count(*) as h, count(distinct nullif(b.sig, '')) as d
    from basics a join basics b on a.candidate and b.candidate and a.scope = b.scope
      and a.normalized_query = b.normalized_query and b.sequence <= a.sequence and b.started_us >= a.started_us - {WINDOW_US}
    group by 1),
ev as (select b.* exclude (candidate, scope, first_rows), case when candidate then scope else '' end as n_plus_1_scope, candidate,
    coalesce(h, 0)::bigint as n_plus_1_hits, coalesce(d, 0)::bigint as n_plus_1_distinct_args,
    coalesce(h >= 5 and d >= 2, false) as n_plus_1 from basics b left join hits using (sequence))"""

# Greedy cooldown per key, one alert per recursion step.
_ALERTS = f"""
matched as (select n_plus_1_scope as s, normalized_query as q, started_us as t, min(sequence) as sequence from ev where n_plus_1 group by 1, 2, 3),
chain(s, q, t) as (
    select s, q, min(t) from matched group by 1, 2
    union all
    select c.s, c.q, min(m.t) from chain c join matched m on m.s = c.s and m.q = c.q and m.t >= c.t + {COOLDOWN_US} group by 1, 2),
alerts as (select e.* from ev e join matched m using (sequence) join chain c on c.s = m.s and c.q = m.q and c.t = m.t)"""

NOTICE = truncate("'N+1 detected in ' || n_plus_1_scope || ' (' || n_plus_1_hits || ' hits, ' || n_plus_1_distinct_args || "
                  "' distinct args): ' || (" + compact("normalized_query", 160) + ")", 300)

_MESSAGES = f"""
m as ({messages_sql('duckdb')}),
seen as (select *,
    last_value(case when kind = 'Bind' then statement_name end ignore nulls) over p as bound_name,
    last_value(case when kind = 'Bind' then arg end ignore nulls) over p as bound_arg,
    last_value(case when kind = 'Parse' then query end ignore nulls) over p as latest
    from m window p as (partition by connection_id order by frame_no rows between unbounded preceding and 1 preceding)),
parses as (select connection_id, statement_name, frame_no, query as parsed from m where kind = 'Parse' and statement_name <> ''),
runs as (select * from seen where kind = 'Execute'),
executed as (select r.connection_id, r.frame_no, r.captured_us, r.bound_name, r.bound_arg, r.latest,
    case when coalesce(r.bound_name, '') <> '' then p.parsed end as named
    from runs r asof left join parses p on r.connection_id = p.connection_id and r.bound_name = p.statement_name and r.frame_no > p.frame_no),
req as (select connection_id, frame_no, captured_us, coalesce(named, latest) as query, coalesce(bound_arg, '') as arg,
      true as extended, coalesce(bound_name, '') as bound_name, named is not null as by_name from executed
    union all select connection_id, frame_no, captured_us, query, '', false, '', false from m where kind = 'Query'),
requests as (select * from req where coalesce(query, '') <> ''),
flow as (select connection_id, frame_no, captured_us, 'Request' as kind, query, arg, extended, '' as tag, 1 as up, 0 as down from requests
    union all select connection_id, frame_no, captured_us, kind, '', arg, false, tag, 0, case when kind in ('Complete','Error') then 1 else 0 end
    from m where kind in ('Complete','Error','DataRow','RowDesc')),
level as (select *, sum(up) over w as opened, sum(down) over w as closes, sum(up - down) over w as s from flow
    window w as (partition by connection_id order by frame_no)),
lows as (select *, least(0, min(s) over (partition by connection_id order by frame_no)) as low,
    least(0, coalesce(min(s) over (partition by connection_id order by frame_no rows between unbounded preceding and 1 preceding), 0)) as low_before,
    max(captured_us) over (partition by connection_id) as last_us from level),
queue as (select *, s - low as depth, down = 1 and low < low_before as orphan, closes + low as closed from lows),
tags as (select *, try_cast(regexp_extract(tag, '([0-9]+)$', 1) as bigint) as tag_rows from queue),
paired as (select o.connection_id, o.opened::bigint as rank, o.frame_no, o.captured_us, o.query, o.arg, o.extended, o.depth::bigint as depth,
    c.frame_no is not null as completed, c.frame_no as completed_frame, coalesce(c.captured_us, o.last_us) as completed_us,
    case when c.frame_no is null then 'connection closed' when c.kind = 'Error' then 'failed ' || c.arg else '' end as error,
    case when c.frame_no is null then 'DISCONNECTED' when c.kind = 'Error' then 'ERROR' else c.tag end as status_tag,
    case when c.kind = 'Complete' then coalesce(c.tag_rows, 0) else 0 end::bigint as rows_affected
    from queue o left join (select * from tags where down = 1 and not orphan) c
      on o.connection_id = c.connection_id and o.opened = c.closed where o.up = 1)"""


# Responses within the usual limits of a preview; each row shows its number and a null word.
_CAPTURED = f"""
arrived as (select connection_id, (closed + 1)::bigint as rank, frame_no, kind, arg from queue
    where kind in ('DataRow','RowDesc') and depth > 0),
placed as (select *, row_number() over (partition by connection_id, rank order by frame_no) as at_row from arrived where kind = 'DataRow'),
answered as (select connection_id, rank, count(*) as response_total_rows, cast(sum(length(arg) + 4) as bigint) as response_total_bytes,
    string_agg(arg || ',NULL', ';' order by frame_no) filter (where at_row <= {TRACE.max_preview_rows}) as response_rows,
    count(*) > {TRACE.max_preview_rows} as response_truncated from placed group by 1, 2),
named as (select connection_id, rank, 'col' || max_by(arg, frame_no) as response_columns from arrived where kind = 'RowDesc' group by 1, 2),
marked as (select *, case when query like 'BEGIN%' then 'BEGIN' when query like 'COMMIT%' then 'COMMIT' end as ctl from paired),
running as (select *, count(*) filter (where ctl = 'BEGIN') over (partition by connection_id order by frame_no) as begins,
    last_value(ctl ignore nulls) over (partition by connection_id order by frame_no rows between unbounded preceding and 1 preceding) as last_ctl from marked),
basics as (select *, coalesce(ctl, case when extended then 'Execute' else 'Query' end) as operation, (completed_us - captured_us) / 1000.0 as duration_ms,
    case when ctl = 'BEGIN' or last_ctl = 'BEGIN' then connection_id || ':' || begins else '' end as tx_id,
    row_number() over (order by completed_us, connection_id, rank) as sequence,
    query like 'SELECT%' as candidate, {norm('query')} as template, case when arg <> '' then arg else query end as sig from running),
scoped as (select *, case when tx_id <> '' then tx_id else connection_id end as scope from basics),
hits as (select a.sequence, count(*) as h, count(distinct b.sig) as d from scoped a join scoped b on a.candidate and b.candidate and a.scope = b.scope
    and a.template = b.template and b.sequence <= a.sequence and b.captured_us >= a.captured_us - {WINDOW_US} group by 1)"""


def captured() -> str:
    return f"""with {_MESSAGES},{_CAPTURED}
select b.connection_id || '-' || b.rank as event_id, sequence, b.connection_id, operation, query, arg as args, captured_us as started_us, duration_ms, error, status_tag,
    rows_affected, tx_id, duration_ms >= 100 as slow, coalesce(h, 0)::bigint as n_plus_1_hits, coalesce(d, 0)::bigint as n_plus_1_distinct_args,
    coalesce(h >= 5 and d >= 2, false) as n_plus_1, coalesce(response_total_rows, 0) as response_total_rows, coalesce(response_total_bytes, 0)::bigint as response_total_bytes,
    coalesce(response_rows, '') as response_rows, coalesce(response_columns, '') as response_columns, coalesce(response_truncated, false) as response_truncated
from scoped b left join hits using (sequence) left join answered a on a.connection_id = b.connection_id and a.rank = b.rank
    left join named n on n.connection_id = b.connection_id and n.rank = b.rank"""


def events(select: str) -> str:
    return f"with {_EVENTS} {select}"


def alerts(select: str) -> str:
    return f"with recursive {_EVENTS}, {_ALERTS} {select}"


def assembly(select: str, more: str = "") -> str:
    return f"with {_MESSAGES}{more} {select}"


def connections(select: str) -> str:
    return f"with log as ({connections_sql('duckdb')}) {select}"
