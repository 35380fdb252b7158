"""Inputs derived from the given tables, written once for Spark and once for DuckDB.

The expressions are the ones of FIXTURES.md; only four spellings differ between
the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.enrich import enrich
from ..operators.materialize import new_path
from ..operators.transactions import assign_transactions
from ..options import Options

# The traces span 30 days, so windows are a day rather than a second, and blocks
# are small enough that every scan crosses many of them.
TRACE = Options(
    nplus1_threshold=5, nplus1_window_s=86400.0, nplus1_cooldown_s=172800.0, block_rows=2048, block_seconds=86400.0)

_SPELLINGS = {
    "spark": {
        "{US}": "unix_micros(cast(ts as timestamp))", "{[}": "array(", "{]}": ")",
        "{NOARR}": "cast(array() as array<string>)",
    },
    "duckdb": {"{US}": "epoch_us(ts)", "{[}": "[", "{]}": "]", "{NOARR}": "cast([] as varchar[])"},
}

_TRACE = """
select event_id + 1 as sequence, concat('c', cast(user_id % 20 as string)) as connection_id,
  {US} as started_us, value as duration_ms, k, event_type,
  case event_type when 'view' then 'Execute' when 'click' then 'Query' when 'error' then 'Query'
    when 'purchase' then 'Exec' else ctl end as operation,
  case event_type
    when 'view' then 'SELECT id, name FROM items WHERE id = $1'
    when 'click' then concat('SELECT  * FROM clicks WHERE u = ', cast(user_id as string), ' AND tag = ',
         chr(39), 'k', cast(k as string), chr(39), chr(39), 'x', chr(39), ' AND v IN (1,2,3.5)')
    when 'error' then concat('SELECT missing_column FROM users WHERE id = ', cast(k as string))
    when 'purchase' then concat('INSERT INTO orders2 VALUES (', cast(user_id as string), ', ', cast(k as string), ')')
    else ctl end as query,
  case when event_type = 'view' then {[}cast(k as string){]} else {NOARR} end as args,
  case when event_type = 'error' then 'column "missing_column" does not exist' else '' end as error,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'INSERT 0 1'
    when 'signup' then ctl else concat('SELECT ', cast(k % 5 as string)) end as status_tag,
  cast(case event_type when 'purchase' then 1 when 'view' then k % 5 when 'click' then k % 5 else 0 end as bigint) as rows_affected,
  cast(case when event_type in ('view','click') then k % 5 else 0 end as bigint) as response_total_rows,
  cast(case when event_type in ('view','click') then k * 8 else 0 end as bigint) as response_total_bytes,
  case when event_type = 'view' then {[}'name'{]} else {NOARR} end as response_columns,
  case when event_type = 'view' and k % 5 > 0 then {[}{[}concat('n|', cast(k as string)){]}{]}
    else {[}{NOARR}{]} end as first_rows
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
        case when event_id % 4 < 2 then 'BEGIN' when event_id % 4 = 2 then 'COMMIT' else 'ROLLBACK' end as ctl
      from events) e
"""

_MESSAGES = """
select concat('c', cast(user_id % 20 as string)) as connection_id, event_id as frame_no, {US} as captured_us,
  case event_type
    when 'view' then case event_id % 4 when 2 then 'Describe' when 3 then 'RowDesc' else 'Parse' end
    when 'click' then case when event_id % 4 = 3 then 'ParamDesc' else 'Bind' end
    when 'purchase' then 'Execute' when 'signup' then 'Complete'
    else case event_id % 4 when 0 then 'Error' when 1 then 'Ready' when 2 then 'DataRow' else 'Query' end end as kind,
  case k % 3 when 0 then '' when 1 then 's1' else 's2' end as statement_name,
  case when k % 10 = 0 then 'BEGIN' when k % 10 = 1 then 'COMMIT'
    else concat('SELECT c FROM t WHERE id = $1 AND f = ', cast(event_id as string)) end as query,
  cast(k as string) as arg, cast(event_id as string) as type_ids,
  case k % 4 when 0 then concat('SELECT ', cast(k as string)) when 1 then concat('INSERT 0 ', cast(k as string))
    when 2 then 'BEGIN' else '' end as tag
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e
"""

_CONNECTIONS = """
select event_id, {US} as at_us, concat('10.', cast(user_id % 4 as string), '.0.', cast(user_id as string)) as client_host,
  case when event_type in ('view', 'signup') then 'open' else 'close' end as action
from events
"""


def _spell(sql: str, engine: str) -> str:
    for mark, words in _SPELLINGS[engine].items():
        sql = sql.replace(mark, words)
    return sql


def trace_sql(engine: str) -> str:
    return _spell(_TRACE, engine)


def messages_sql(engine: str) -> str:
    return _spell(_MESSAGES, engine)


def connections_sql(engine: str) -> str:
    return _spell(_CONNECTIONS, engine)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _from_events(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from events", "from {events}"), events=table(spark, folder, "events"))


def raw_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Assembled events, before any derived column."""
    rows = _from_events(spark, folder, trace_sql("spark"))
    return rows.withColumns({
        "event_id": F.concat(F.lit("e"), F.col("sequence").cast("string")),
        "response_rows": F.filter("first_rows", lambda r: F.size(r) > 0),
        "response_truncated": F.col("response_total_rows") > F.lit(1),
    }).drop("k", "event_type", "first_rows")


def trace_tx(spark: SparkSession, folder: str) -> DataFrame:
    return assign_transactions(raw_trace(spark, folder), "sequence", TRACE.block_rows)


def fresh_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Query events with every derived column, computed from the tables."""
    return enrich(trace_tx(spark, folder), TRACE)


_stored: dict[tuple[str, str], str] = {}


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """The stored event table: enrichment writes it once, every analysis reads it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        path = new_path(spark, "events")
        fresh_trace(spark, folder).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded messages for assembly."""
    return _from_events(spark, folder, messages_sql("spark")).withColumns({
        "args": F.array("arg"), "type_ids": F.array(F.col("type_ids").cast("bigint")),
        "error": F.concat(F.lit("failed "), F.col("arg")), "columns": F.array(F.concat(F.lit("col"), F.col("arg"))),
        "cells": F.array("arg", F.lit("NULL")), "cell_bytes": F.length("arg").cast("bigint"),
    })


def connections(spark: SparkSession, folder: str) -> DataFrame:
    return _from_events(spark, folder, connections_sql("spark"))
