"""Registered queries over frames, messages, responses, connection logs and literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text, wire
from ..operators import analytics, assemble, capture, compare, decode
from ..operators.materialize import new_path
from ..options import Options
from ..sources import readers
from . import oracle as O
from .event_queries import Query
from .fixtures import TRACE, connections, messages, table

QUERIES: dict[str, tuple[Query, str | None]] = {}
ROWS = TRACE.block_rows


def over(name: str, answer: str | None, make: Callable[[DataFrame], DataFrame], source: Query) -> None:
    QUERIES[name] = (lambda spark, folder: make(source(spark, folder)), answer)


# --- payloads built from orders ------------------------------------------------------------

def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("word"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("date_us"), F.col("o_totalprice").alias("price"))


def _text(c: Column | str) -> Column:
    return F.encode(F.lit(c) if isinstance(c, str) else c, "UTF-8")


def _raw(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _int(c: Column, width: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(c.cast("bigint")), 16, "0"), F.lit(width * 2)))


def _sized(c: Column) -> Column:
    return F.concat(_int(F.octet_length(c), 4), c)


NUL = "00"


def _payloads() -> dict[str, Column]:
    word, key = _text(F.col("word")), F.col("key")
    signed = F.when(key % 2 == 1, -key).otherwise(key)
    return {
        "query": F.concat(word, _raw(NUL)),
        "parse": F.concat(_text("s1"), _raw(NUL), word, _raw("000002"), _int(key, 4), _raw("00000017")),
        "describe": F.concat(F.when(key % 3 == 0, _text("P")).otherwise(_text("S")), word, _raw(NUL)),
        "bind": F.concat(_text("p"), _raw(NUL), _text("s1"), _raw("00000200000001"), _raw("0003"), _sized(word),
                         _sized(_int(signed, 8)), _raw("FFFFFFFF")),
        "row_description": F.concat(_raw("0002"), word, _raw(NUL + "00" * 18), _text("n"), _raw(NUL + "01" * 18)),
        "data_row": F.concat(_raw("0003"), _sized(word), _raw("FFFFFFFF"), _sized(F.concat(_raw("FF"), _int(key, 2)))),
        "param_description": F.concat(_raw("0002"), _int(key, 4), _raw("FFFFFFFF")),
        "tag": F.concat(_text(F.concat(F.lit("INSERT 0 "), (key % 7).cast("string"))), _raw(NUL)),
        "error": F.concat(_text("SERROR"), _raw(NUL), _text("Mold"), _raw(NUL), _text(F.concat(F.lit("M"), F.col("word"))), _raw("0000")),
    }


def payload(name: str, answer: str, kind: str, decoder: Callable[[Column], Column], show: Callable[[Column], list[Column]]) -> None:
    """Decode one payload per order; the decoded value is a column of its own, so it is computed once."""
    def make(spark: SparkSession, folder: str) -> DataFrame:
        frames = _orders(spark, folder).select("key", _payloads()[kind].alias("payload"))
        return frames.select("key", decoder(F.col("payload")).alias("d")).select("key", *show(F.col("d")))

    QUERIES[name] = (make, answer)


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).select(
        F.concat(F.lit("c"), (F.col("customer") % 20).cast("string")).alias("connection_id"), F.col("key").alias("frame_no"),
        F.col("date_us").alias("captured_us"), F.lit("c").alias("direction"), F.lit("Q").alias("msg_type"),
        _payloads()["query"].alias("payload"))


def _frame_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "frames")
    _frames(spark, folder).write.parquet(path)
    frames = readers.read_frames(spark, path)
    return decode.decode_frames(frames).select("connection_id", "frame_no", "captured_us", "kind", "query")


QUERIES["src1_frame_scan"] = (_frame_scan, (
    "select 'c' || (o_custkey % 20) as connection_id, o_orderkey as frame_no, epoch_us(o_orderdate) as captured_us, 'Query' as kind, "
    "o_orderpriority as query from orders"))


def _frame_sizes(spark: SparkSession, folder: str) -> DataFrame:
    good, bad = decode.validate_frames(_frames(spark, folder), 12)
    return good.select("frame_no", F.lit("").alias("problem")).unionByName(bad.select("frame_no", "problem"))


_SIZE = "length(o_orderpriority) + 5"
QUERIES["src2_frame_size"] = (_frame_sizes, (
    f"select o_orderkey as frame_no, case when {_SIZE} > 12 then 'packet is too large (' || ({_SIZE}) || ' bytes > limit 12 bytes)' else '' end as problem from orders"))

_SIGNED = "case when o_orderkey % 2 = 1 then -o_orderkey else o_orderkey end"
payload("dec1_query", "select o_orderkey as key, o_orderpriority as query from orders", "query",
        wire.decode_query, lambda d: [d.alias("query")])
payload("dec2_parse", "select o_orderkey as key, 's1' as statement_name, o_orderpriority as query, o_orderkey || ',23' as types from orders", "parse",
        wire.decode_parse, lambda d: [d["statement_name"].alias("statement_name"), d["query"].alias("query"),
                                      F.array_join(d["type_ids"].cast("array<string>"), ",").alias("types")])
payload("dec3_describe", "select o_orderkey as key, case when o_orderkey % 3 = 0 then 'P' else 'S' end as object, o_orderpriority as name from orders", "describe",
        wire.decode_describe, lambda d: [d["object"].alias("object"), d["statement_name"].alias("name")])
payload("dec4_bind", f"select o_orderkey as key, 'p' as portal, 's1' as statement_name, '0,1' as codes, o_orderpriority || '|' || ({_SIGNED}) || '|NULL' as args from orders",
        "bind", wire.decode_bind, lambda d: [
            d["portal"].alias("portal"), d["statement_name"].alias("statement_name"),
            F.array_join(d["format_codes"].cast("array<string>"), ",").alias("codes"),
            F.array_join(wire.decode_args(d["params"], d["format_codes"], F.array(F.lit(25), F.lit(20)).cast("array<bigint>")), "|").alias("args")])
payload("dec9_row_description", "select o_orderkey as key, o_orderpriority || ',n' as columns from orders", "row_description",
        wire.decode_row_description, lambda d: [F.array_join(d, ",").alias("columns")])
payload("dec10_data_row", "select o_orderkey as key, 3::bigint as fields, true as second_null, length(o_orderpriority)::bigint as first_size from orders", "data_row",
        wire.decode_data_row, lambda d: [F.size(d).cast("bigint").alias("fields"), F.get(d, F.lit(1)).isNull().alias("second_null"),
                                         F.octet_length(F.get(d, F.lit(0))).cast("bigint").alias("first_size")])
payload("dec11_cell_text", "select o_orderkey as key, o_orderpriority || '|NULL|0xff' || lpad(lower(to_hex(o_orderkey % 65536)), 4, '0') as cells from orders", "data_row",
        wire.decode_data_row, lambda d: [F.array_join(F.transform(d, wire.cell_text), "|").alias("cells")])
payload("dec12_param_description", "select o_orderkey as key, o_orderkey || ',4294967295' as types from orders", "param_description",
        wire.decode_param_description, lambda d: [F.array_join(d.cast("array<string>"), ",").alias("types")])
payload("dec13_command_tag", "select o_orderkey as key, 'INSERT 0 ' || (o_orderkey % 7) as tag, o_orderkey % 7 as rows_affected from orders", "tag",
        wire.decode_command_tag, lambda d: [d.alias("tag"), wire.rows_affected(d).alias("rows_affected")])
payload("dec14_error", "select o_orderkey as key, o_orderpriority as error from orders", "error",
        wire.decode_error, lambda d: [d.alias("error")])


def _format_rule(spark: SparkSession, folder: str) -> DataFrame:
    codes = (F.when(F.col("key") % 3 == 0, F.array().cast("array<bigint>"))
             .when(F.col("key") % 3 == 1, F.array((F.col("key") % 2).cast("bigint")))
             .otherwise(F.array(F.lit(0), (F.col("key") % 2)).cast("array<bigint>")))
    return _orders(spark, folder).select("key", *[
        wire.is_binary_param(codes, F.lit(i)).alias(f"binary_{i}") for i in range(3)])


QUERIES["dec5_format_rule"] = (_format_rule, (
    "select o_orderkey as key, o_orderkey % 3 = 1 and o_orderkey % 2 = 1 as binary_0, "
    "o_orderkey % 3 > 0 and o_orderkey % 2 = 1 as binary_1, o_orderkey % 3 = 1 and o_orderkey % 2 = 1 as binary_2 from orders"))


def _parameters(spark: SparkSession, folder: str) -> DataFrame:
    key, word = F.col("key"), _text(F.col("word"))
    signed = F.when(key % 2 == 1, -key).otherwise(key)
    case = key % 11
    kinds = [
        (0, 25, word, False), (1, wire.BOOL, _int(key % 2, 1), True), (2, wire.INT2, _int(signed % 30000, 2), True),
        (3, wire.INT4, _int(signed, 4), True), (4, wire.OID, _int(signed, 4), True), (5, wire.INT8, _int(signed, 8), True),
        (6, wire.BYTEA, word, True), (7, wire.UUID, F.concat(_int(key, 8), _int(key, 8)), True),
        (8, 0, F.concat(_int(key, 8), _int(key, 8)), True), (9, 999, _int(key, 4), True), (10, 25, F.lit(None).cast("binary"), False),
    ]
    raw = type_id = binary = F
    for at, oid, value, is_binary in kinds:
        raw, type_id, binary = raw.when(case == at, value), type_id.when(case == at, oid), binary.when(case == at, is_binary)
    rows = _orders(spark, folder).select("key", raw.alias("raw"), type_id.alias("type_id"), binary.alias("binary"))
    return rows.select("key", wire.decode_parameter(F.col("raw"), F.col("type_id"), F.col("binary")).alias("value"))


_HEX16 = "lpad(lower(to_hex(o_orderkey)), 16, '0')"
_UUID = f"left({_HEX16}, 8) || '-' || substr({_HEX16}, 9, 4) || '-' || substr({_HEX16}, 13, 4) || '-' || left({_HEX16}, 4) || '-' || substr({_HEX16}, 5)"
QUERIES["dec6_parameters"] = (_parameters, (
    "select o_orderkey as key, case o_orderkey % 11 when 0 then o_orderpriority when 1 then case when o_orderkey % 2 = 1 then 'true' else 'false' end "
    f"when 2 then (({_SIGNED}) % 30000)::varchar when 3 then ({_SIGNED})::varchar when 4 then ({_SIGNED})::varchar when 5 then ({_SIGNED})::varchar "
    f"when 6 then '\\x' || lower(hex(o_orderpriority)) when 7 then {_UUID} when 8 then {_UUID} "
    "when 9 then '0x' || lpad(lower(to_hex(o_orderkey)), 8, '0') else 'NULL' end as value from orders"))


def _timestamps(spark: SparkSession, folder: str) -> DataFrame:
    us = F.col("date_us") - wire.WIRE_EPOCH_US + F.when(F.col("key") % 2 == 1, F.col("key")).otherwise(0)
    value = wire.decode_parameter(_int(us, 8), F.lit(wire.TIMESTAMP), F.lit(True))
    return _orders(spark, folder).select("key", value.alias("value"))


_TS = "(epoch_us(o_orderdate) + case when o_orderkey % 2 = 1 then o_orderkey else 0 end)"
QUERIES["dec7_timestamp"] = (_timestamps, f"select o_orderkey as key, {O.iso(_TS)} as value from orders")

# --- assembly of the message stream ----------------------------------------------------------

over("dec8_execute", O.assembly("select connection_id, frame_no from m where kind = 'Execute'"),
     lambda m: m.where("kind = 'Execute'").select("connection_id", "frame_no"), messages)
over("dec15_ready_epochs", O.assembly(
    "select connection_id, frame_no, cast(count(*) filter (where kind = 'Ready') over (partition by connection_id order by frame_no) as bigint) as epoch from m"),
     lambda m: assemble.blocks.running_sum(m, ["connection_id"], "frame_no", {"epoch": (F.col("kind") == "Ready").cast("int")}, ROWS)
     .select("connection_id", "frame_no", "epoch"), messages)


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.resolve_statements(messages(spark, folder), ROWS)


over("asm1_statement_lookup", O.assembly("select connection_id, frame_no, query from requests where extended"),
     lambda r: r.where("extended").select("connection_id", "frame_no", "query"), _requests)
over("asm2_statement_fallback", O.assembly(
    "select connection_id, count(*) as runs, max(query) as last_query from requests where extended group by 1"),
     lambda r: r.where("extended").groupBy("connection_id").agg(F.count(F.lit(1)).alias("runs"), F.max("query").alias("last_query")), _requests)
over("asm3_bind_args", O.assembly("select connection_id, frame_no, arg as args from requests where extended"),
     lambda r: r.where("extended").select("connection_id", "frame_no", F.array_join("args", "|").alias("args")), _requests)

_TYPES = """,
epochs as (select *, count(*) filter (where kind = 'Ready') over (partition by connection_id order by frame_no) as epoch from m),
asks as (select *, sum(case kind when 'Describe' then 1 else -1 end) over w as s, count(*) filter (where kind = 'Describe') over w as d,
    count(*) filter (where kind = 'ParamDesc') over w as t from epochs where kind in ('Describe','ParamDesc')
    window w as (partition by connection_id, epoch order by frame_no)),
asklows as (select *, least(0, min(s) over (partition by connection_id, epoch order by frame_no)) as low,
    least(0, coalesce(min(s) over (partition by connection_id, epoch order by frame_no rows between unbounded preceding and 1 preceding), 0)) as low_before from asks),
answers as (select a.connection_id, a.frame_no, q.statement_name, a.type_ids from asklows a join asklows q
    on a.connection_id = q.connection_id and a.epoch = q.epoch and q.kind = 'Describe' and a.t + a.low = q.d
    where a.kind = 'ParamDesc' and not a.low < a.low_before),
told as (select connection_id, frame_no, statement_name, type_ids, true as any_name from m where kind = 'Parse'
    union all select connection_id, frame_no, statement_name, type_ids, statement_name = '' from answers),
binds as (select * from m where kind = 'Bind'),
typed as (select b.connection_id, b.frame_no, b.statement_name, l.type_ids as latest from binds b asof left join (select * from told where any_name) l
    on b.connection_id = l.connection_id and b.frame_no > l.frame_no),
bound as (select t.connection_id, t.frame_no, coalesce(case when t.statement_name <> '' then n.type_ids end, t.latest, '') as types from typed t
    asof left join (select * from told where statement_name <> '') n
    on t.connection_id = n.connection_id and t.statement_name = n.statement_name and t.frame_no > n.frame_no)"""


def _joined(types: str) -> Column:
    return F.array_join(F.col(types).cast("array<string>"), ",")


over("asm4_param_types", O.assembly("select connection_id, frame_no, types from bound", _TYPES),
     lambda m: assemble.resolve_param_types(m, ROWS).select("connection_id", "frame_no", _joined("bind_types").alias("types")), messages)
over("asm5_describe_pairing", O.assembly("select connection_id, frame_no, statement_name, type_ids as types from answers", _TYPES),
     lambda m: assemble.describe_results(m, ROWS).select("connection_id", "frame_no", "statement_name", _joined("type_ids").alias("types")), messages)


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.scan_messages(messages(spark, folder), ROWS)


over("asm6_fifo_pairing", O.assembly("select connection_id, rank, frame_no, completed, completed_frame, error, status_tag, rows_affected from paired"),
     lambda s: assemble.pair_requests(s).select(
         "connection_id", "rank", "frame_no", "completed", "completed_frame", "error", "status_tag", "rows_affected"), _scanned)
over("asm6_orphans", O.assembly("select connection_id, frame_no from queue where orphan"),
     lambda s: s.where("is_orphan").select("connection_id", "frame_no"), _scanned)
over("asm7_flush", O.assembly("select connection_id, rank, error, status_tag, rows_affected, completed_us from paired where not completed"),
     lambda s: assemble.pair_requests(s).where("not completed").select(
         "connection_id", "rank", "error", "status_tag", "rows_affected", "completed_us"), _scanned)
over("asm8_queue_depth", O.assembly("select connection_id, frame_no, depth::bigint as depth from queue where up = 1"),
     lambda s: s.where("is_open").select("connection_id", "frame_no", "depth"), _scanned)


def _capped(spark: SparkSession, folder: str) -> DataFrame:
    scanned = assemble.scan_messages(messages(spark, folder), ROWS, 3)
    return assemble.pair_requests(scanned).select("connection_id", "rank", "frame_no", "completed", "completed_frame")


# The limit of 3 is far below the default, so that it bites in this data.
over("asm8_queue_cap", O.assembly("""select o.connection_id, o.opened::bigint as rank, o.frame_no, c.frame_no is not null as completed, c.frame_no as completed_frame
    from restated o left join (select * from restated where down = 1 and not orphan) c on o.connection_id = c.connection_id and o.opened = c.closed where o.up = 1""", """,
breach as (select connection_id, min(frame_no) as at_frame from queue where up = 1 and depth > 3 group by 1),
kept as (select f.* from flow f left join breach b using (connection_id) where f.up = 0 or b.at_frame is null or f.frame_no < b.at_frame),
kept_level as (select *, sum(up) over w as opened, sum(down) over w as closes, sum(up - down) over w as s from kept
    window w as (partition by connection_id order by frame_no)),
restated as (select *, closes + low as closed, down = 1 and low < low_before as orphan from (select *, least(0, min(s) over (partition by connection_id order by frame_no)) as low,
    least(0, coalesce(min(s) over (partition by connection_id order by frame_no rows between unbounded preceding and 1 preceding), 0)) as low_before from kept_level))"""),
     lambda d: d, _capped)

_PREVIEW = Options(max_preview_rows=3, max_preview_bytes=9)
_ROWS = """,
arrived as (select connection_id, (closed + 1)::bigint as rank, frame_no, kind, arg from queue where kind in ('DataRow','RowDesc') and depth > 0),
sized as (select *, row_number() over w as at_row, sum(length(arg) + 4) over w as upto from arrived where kind = 'DataRow'
    window w as (partition by connection_id, rank order by frame_no)),
answered as (select connection_id, rank, count(*) as response_total_rows, cast(sum(length(arg)) as bigint) as response_total_bytes,
    coalesce(string_agg(arg || ',NULL', ';' order by frame_no) filter (where at_row <= 3 and upto <= 9), '') as response_rows,
    count(*) > count(*) filter (where at_row <= 3 and upto <= 9) as response_truncated from sized group by 1, 2),
named as (select connection_id, rank, 'col' || max_by(arg, frame_no) as response_columns from arrived where kind = 'RowDesc' group by 1, 2)"""
over("asm9_response_attach", O.assembly(
    "select coalesce(a.connection_id, n.connection_id) as connection_id, coalesce(a.rank, n.rank) as rank, response_total_rows, response_total_bytes, "
    "response_rows, response_truncated, response_columns from answered a full join named n on a.connection_id = n.connection_id and a.rank = n.rank", _ROWS),
     lambda s: assemble.attach_responses(s, _PREVIEW).select(
         "connection_id", "rank", "response_total_rows", "response_total_bytes",
         F.array_join(F.transform("response_rows", lambda r: F.array_join(r, ",")), ";").alias("response_rows"),
         "response_truncated", F.array_join("response_columns", ",").alias("response_columns")), _scanned)


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.array("text").alias("cells"), F.octet_length("text").cast("bigint").alias("cell_bytes"))
    return assemble.preview(rows, ["conv_id"], "turn", Options(max_preview_rows=3, max_preview_bytes=500))


over("asm10_response_totals", "select conv_id, count(*) as response_total_rows, cast(sum(strlen(text)) as bigint) as response_total_bytes from conversations group by 1",
     lambda d: d.select("conv_id", "response_total_rows", "response_total_bytes"), _answers)
_CUT = O.truncate("text", 200)
over("asm11_bounded_preview", f"""with cut as (select conv_id, turn, {_CUT} as cell from conversations),
sized as (select *, row_number() over w as at_row, sum(strlen(cell)) over w as upto from cut window w as (partition by conv_id order by turn))
select conv_id, coalesce(md5(string_agg(cell, ';' order by turn) filter (where at_row <= 3 and upto <= 500)), '') as shown,
    count(*) filter (where at_row <= 3 and upto <= 500) as kept, count(*) > count(*) filter (where at_row <= 3 and upto <= 500) as response_truncated
    from sized group by 1""",
     lambda d: d.select(
         "conv_id", F.when(F.size("response_rows") > 0, F.md5(F.encode(F.array_join(F.transform("response_rows", lambda r: F.array_join(r, ",")), ";"), "UTF-8")))
         .otherwise("").alias("shown"), F.size("response_rows").cast("bigint").alias("kept"), "response_truncated"), _answers)
over("asm12_duration", O.assembly("select connection_id, rank, (completed_us - captured_us) / 1000.0 as duration_ms from paired"),
     lambda s: assemble.pair_requests(s).select(
         "connection_id", "rank", ((F.col("completed_us") - F.col("captured_us")) / F.lit(1000.0)).alias("duration_ms")), _scanned)


def _assembled(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.assemble_events(messages(spark, folder), TRACE)


over("asm15_event_ids", O.assembly(
    "select connection_id || '-' || rank as event_id, frame_no, case when upper(trim(query)) like 'BEGIN%' then 'BEGIN' "
    "when upper(trim(query)) like 'COMMIT%' then 'COMMIT' when extended then 'Execute' else 'Query' end as operation from paired"),
     lambda e: e.select("event_id", "frame_no", "operation"), _assembled)
over("asm16_sequence", O.assembly(
    "select connection_id || '-' || rank as event_id, row_number() over (order by completed_us, connection_id, rank) as sequence from paired"),
     lambda e: assemble.assign_sequence(e, "completed_us", "connection_id", "rank").select("event_id", "sequence"), _assembled)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _md5(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


over("asm17_field_limits", f"select doc_id, md5({O.truncate('text', 20000)}) as query, md5({O.truncate('text', 1000)}) as arg, md5({O.truncate('text', 200)}) as cell from documents",
     lambda d: assemble.apply_limits(d.select("doc_id", "text", F.col("text").alias("query"), F.array("text").alias("args")), Options(max_query_chars=20000, max_arg_chars=1000)).select(
         "doc_id", _md5(F.col("query")).alias("query"), _md5(F.get("args", F.lit(0))).alias("arg"),
         _md5(text.truncate_text(F.col("text"), 200)).alias("cell")), _documents)

# --- the whole way from frames ---------------------------------------------------------------------


def _captured(spark: SparkSession, folder: str) -> DataFrame:
    """Every message of the fixture as a frame; sizes in front of lists as the wire has them."""
    name, statement, arg = (_text(F.col(c)) for c in ("statement_name", "query", "arg"))
    nul, one = _raw(NUL), _raw("0001")
    type_id = _int(F.get("type_ids", F.lit(0)), 4)
    # Side and letter of each kind of message.
    frames = {
        "Query": ("c", "Q", F.concat(statement, nul)), "Parse": ("c", "P", F.concat(name, nul, statement, nul, one, type_id)),
        "Describe": ("c", "D", F.concat(_text("S"), name, nul)),
        "Bind": ("c", "B", F.concat(nul, name, nul, _raw("0000"), one, _sized(arg))),
        "Execute": ("c", "E", _raw(NUL * 5)), "ParamDesc": ("s", "t", F.concat(one, type_id)),
        "RowDesc": ("s", "T", F.concat(one, _text("col"), arg, _raw(NUL * 19))),
        "DataRow": ("s", "D", F.concat(_raw("0002"), _sized(arg), _sized(_text("NULL")))),
        "Complete": ("s", "C", F.concat(_text(F.col("tag")), nul)),
        "Error": ("s", "E", F.concat(_text("SERROR"), nul, _text("Mfailed "), arg, _raw(NUL * 2))), "Ready": ("s", "Z", _text("I")),
    }
    side = letter = body = F
    for kind, (s, m, payload_) in frames.items():
        side, letter, body = side.when(F.col("kind") == kind, s), letter.when(F.col("kind") == kind, m), body.when(F.col("kind") == kind, payload_)
    return messages(spark, folder).select("connection_id", "frame_no", "captured_us", side.alias("direction"), letter.alias("msg_type"), body.alias("payload"))


over("path1_frames_to_events", O.captured(), lambda frames: capture.frames_to_events(frames, TRACE)[0].select(
    "event_id", "sequence", "connection_id", "operation", "query", F.array_join("args", "|").alias("args"), "started_us", "duration_ms",
    "error", "status_tag", "rows_affected", "tx_id", "slow", "n_plus_1_hits", "n_plus_1_distinct_args", "n_plus_1", "response_total_rows",
    "response_total_bytes", F.array_join(F.transform("response_rows", lambda r: F.array_join(r, ",")), ";").alias("response_rows"),
    F.array_join("response_columns", ",").alias("response_columns"), "response_truncated"), _captured)

# --- scalars on documents and literals -----------------------------------------------------------

over("sca1_truncate", f"select doc_id, {O.truncate('text', 100)} as cut, left(text, 10) as plain, md5(text) as off from documents",
     lambda d: d.select("doc_id", text.truncate_text(F.col("text"), 100).alias("cut"), text.truncate_text(F.col("text"), 10).alias("plain"),
                        _md5(text.truncate_text(F.col("text"), 0)).alias("off")), _documents)
# Unicode spaces are outside the oracle's \s, so it names the ones that occur.
_LINE = "trim(regexp_replace(text, '[\\x00-\\x20\\x7f\\x{85}\\x{a0}\\x{2028}\\x{2029}\\x{202f}\\x{3000}\\x{2000}-\\x{200a}]+', ' ', 'g'))"
over("sca2_compact", f"select doc_id, case when length({_LINE}) <= 120 then {_LINE} else left({_LINE}, 117) || '...' end as compact from documents",
     lambda d: d.select("doc_id", text.compact_query(F.col("text"), 120).alias("compact")), _documents)
over("sca3_sanitize", "select doc_id, md5(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g')) as clean from documents",
     lambda d: d.select("doc_id", _md5(text.sanitize(F.col("text"))).alias("clean")), _documents)

# How a statement may begin, with its operation and whether it only reads.
OPERATIONS = [
    ("  select 1", "Query", "true"), ("Show all", "Query", "true"), ("WITH x AS (SELECT 1) DELETE FROM t", "Query", "true"),
    ("begin work", "BEGIN", "false"), ("COMMIT;", "COMMIT", "false"), ("rollback to a", "ROLLBACK", "false"),
    ("START TRANSACTION", "Exec", "false"), ("-- c\nselect 1", "Exec", "true"), ("/* a */ -- b\n values (1)", "Exec", "true"),
    ("explain analyze delete from t", "Query", "true"), ("/* begin */ begin", "Exec", "false"), ("fetch 5 from c", "Query", "true"),
    ("/**/\t--x\n\nFETCH", "Exec", "true"),
]
# Units of a duration with their parts of a second; the last is none.
UNITS = [("us", 1_000_000.0), ("µs", 1_000_000.0), ("ms", 1000.0), ("S", 1.0), ("m", 1 / 60), ("h", None)]


def _sql_list(values: list[object]) -> str:
    def word(v: object) -> str:
        return "null" if v is None else repr(v) if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"

    return "[" + ", ".join(word(v) for v in values) + "]"


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text behind one of the beginnings."""
    pick = (F.col("doc_id") % len(OPERATIONS)).cast("int")
    begins = F.get(F.array(*[F.lit(t) for t, _, _ in OPERATIONS]), pick)
    return _documents(spark, folder).select("doc_id", F.concat_ws(" ", begins, "text").alias("value"))


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every event's number with one of the units."""
    unit = F.get(F.array(*[F.lit(u) for u, _ in UNITS]), (F.col("event_id") % len(UNITS)).cast("int"))
    return table(spark, folder, "events").select("event_id", F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5"), unit).alias("value"))


over("asm14_operation", f"select doc_id, {_sql_list([op for _, op, _ in OPERATIONS])}[doc_id % {len(OPERATIONS)} + 1] as result from documents",
     lambda d: d.select("doc_id", text.infer_operation(F.col("value")).alias("result")), _statements)
over("fil22_read_only", f"select doc_id, {_sql_list([ok for _, _, ok in OPERATIONS])}[doc_id % {len(OPERATIONS)} + 1]::boolean as result from documents",
     lambda d: d.select("doc_id", text.is_read_only(F.col("value")).alias("result")), _statements)
over("sca5_sql_literal", "select doc_id, md5('''' || replace(replace(text, '\\', '\\\\'), '''', '''''') || '''') as result from documents",
     lambda d: d.select("doc_id", _md5(text.sql_literal(F.col("text"))).alias("result")), _documents)
over("sca9_duration_token", f"select event_id, (event_id + 0.5)::double / {_sql_list([x for _, x in UNITS])}[event_id % {len(UNITS)} + 1]::double as result from events",
     lambda d: d.select("event_id", text.duration_seconds(F.col("value")).alias("result")), _tokens)
over("sca10_escape_pipe", "select doc_id, md5(replace(text, '|', '\\|')) as result from documents",
     lambda d: d.select("doc_id", _md5(text.escape_pipe(F.col("text"))).alias("result")), _documents)

# --- connection log ----------------------------------------------------------------------------------

ALLOWED = "10.1.0.0/16, 10.2.0.0/25"
_IN = ("(client_host like '10.1.%' or (client_host like '10.2.0.%' and cast(split_part(client_host, '.', 4) as int) < 128))")
over("joi4_allowed_clients", O.connections(f"select event_id, client_host from log where {_IN}"),
     lambda d: compare.allow_clients(d, ALLOWED).select("event_id", "client_host"), connections)
over("joi4_denied_clients", O.connections(f"select event_id, client_host from log where not {_IN}"),
     lambda d: compare.allow_clients(d, ALLOWED, keep=False).select("event_id", "client_host"), connections)
over("agg12_active_connections", O.connections(
    "select event_id as \"order\", action, (s - least(0, min(s) over (order by event_id)))::bigint as active_connections from ("
    "select *, sum(case action when 'open' then 1 else -1 end) over (order by event_id) as s from log)"),
     lambda d: analytics.active_connections(d.withColumnRenamed("event_id", "order"), ROWS), connections)
