"""Assembly of query events from decoded messages.

A message row has ``connection_id``, ``frame_no`` (rising along a connection),
``captured_us``, ``kind`` and the fields its kind needs:

    Query     query                    Parse      statement_name, query, type_ids
    Describe  statement_name           Bind       statement_name, args
    Execute   -                        ParamDesc  type_ids
    RowDesc   columns                  DataRow    cells, cell_bytes
    Complete  tag                      Error      error
    Ready     -

Connections are scanned in blocks (``blocks.py``), so one connection may hold
any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text, wire
from ..options import Options
from . import blocks
from .blocks import number_rows
from .materialize import materialize
from .transactions import assign_transactions

_CONN = ["connection_id"]
_ORDER = "frame_no"
_NO_TEXTS = "array<string>"

FLUSH_ERROR, FLUSH_TAG, ERROR_TAG = "connection closed", "DISCONNECTED", "ERROR"


def _kind(*names: str) -> Column:
    return F.col("kind").isin(*names)


def _starts_by_tree(folded: DataFrame, keys: Sequence[str], block_rows: int, fan: int) -> DataFrame:
    """What each block starts from (``_o0``, ``_x0``, ``_low0``), by a tree of blocks of blocks.

    A block is its opens, closes and lowest level; two neighbours make one again. A level
    folds ``fan`` neighbours to their parent, until every key has a single one; then each
    parent's start is handed down to its children. Only the children of one parent meet,
    so no task sees all blocks of a key, also where there is no key at all. The number of
    levels is that of the longest key.
    """
    zero = F.lit(0).cast("bigint")
    ends = folded.agg(F.min(blocks.BLOCK).alias("low"), F.max(blocks.BLOCK).alias("high")).first()
    least, number = ends["low"] or 0, ((ends["high"] or 0) - (ends["low"] or 0)) // block_rows + 1
    floor = folded.withColumn("_n", ((F.col(blocks.BLOCK) - least) / block_rows).cast("bigint"))
    floors = []
    while True:
        among = Window.partitionBy(*keys, "_up").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
        placed = floor.withColumn("_up", F.floor(F.col("_n") / fan)).withColumns({
            "_oi": F.coalesce(F.sum("_bo").over(among), zero), "_xi": F.coalesce(F.sum("_bx").over(among), zero)})
        placed = materialize(placed.withColumn("_li", F.min(F.col("_oi") - F.col("_xi") + F.col("_bl")).over(among)))
        floors.append(placed)
        number = -(-number // fan)
        if number == 1:
            break
        floor = placed.groupBy(*keys, F.col("_up").alias("_n")).agg(
            F.sum("_bo").alias("_bo"), F.sum("_bx").alias("_bx"), F.min(F.col("_oi") - F.col("_xi") + F.col("_bl")).alias("_bl"))
    starts = None
    for placed in reversed(floors):
        if starts is None:
            given = placed.withColumns({"_po": zero, "_px": zero, "_pl": zero})
        else:
            given = placed.join(starts.select(*keys, F.col("_n").alias("_up"), F.col("_o0").alias("_po"), F.col("_x0").alias("_px"), F.col("_low0").alias("_pl")), [*keys, "_up"])
        starts = given.withColumns({
            "_o0": F.col("_po") + F.col("_oi"), "_x0": F.col("_px") + F.col("_xi"), "_low0": F.least("_pl", F.col("_po") - F.col("_px") + F.col("_li"))})
    return starts.select(*keys, blocks.BLOCK, "_o0", "_x0", "_low0")


def fifo_counts(df: DataFrame, keys: Sequence[str], order: str, opens: Column, closes: Column,
                block_rows: int, last: str | None = None, fan: int | None = None) -> DataFrame:
    """Queue counters after each row: ``opened``, ``closed`` (orphans excluded), ``depth``.

    With S the running opens minus closes, every new low of S below zero is a
    close that found the queue empty. So the orphans so far are -``low``, low
    being min(0, S's running minimum), and the k-th surviving close belongs to
    the k-th open. ``is_open``, ``is_close`` and ``is_orphan`` tell the row's own
    role; ``closes`` counts all closes. ``last`` names a column whose maximum
    over the key is added as ``key_last``. With ``fan``, blocks are scanned by a tree
    of that width (without ``last``), for keys that may be the whole table.
    """
    staged = blocks.with_block(df.withColumns({
        "is_open": F.coalesce(opens, F.lit(False)), "is_close": F.coalesce(closes, F.lit(False)),
    }), order, block_rows)
    here = blocks.within(keys, order)
    local = staged.withColumns({
        "_o": F.sum(F.col("is_open").cast("bigint")).over(here),
        "_x": F.sum(F.col("is_close").cast("bigint")).over(here),
    }).withColumn("_low", F.min(F.col("_o") - F.col("_x")).over(here))

    earlier = blocks.earlier_blocks(keys)
    zero = F.lit(0).cast("bigint")
    top = [F.max(last).alias("_bt")] if last else []
    key_last = [F.max("_bt").over(Window.partitionBy(*keys)).alias("key_last")] if last else []
    folded = local.groupBy(*keys, blocks.BLOCK).agg(F.max("_o").alias("_bo"), F.max("_x").alias("_bx"), F.min("_low").alias("_bl"), *top)
    starts = _starts_by_tree(materialize(folded), keys, block_rows, fan) if fan else (
        folded.withColumns({
            "_o0": F.coalesce(F.sum("_bo").over(earlier), zero),
            "_x0": F.coalesce(F.sum("_bx").over(earlier), zero),
        })
        .withColumn("_low0", F.least(zero, F.min(F.col("_o0") - F.col("_x0") + F.col("_bl")).over(earlier)))
        .select(*keys, blocks.BLOCK, "_o0", "_x0", "_low0", *key_last)
    )
    counted = local.join(starts, [*keys, blocks.BLOCK]).withColumns({
        "opened": F.col("_o0") + F.col("_o"),
        "closes": F.col("_x0") + F.col("_x"),
        "low": F.least(F.col("_low0"), F.col("_o0") - F.col("_x0") + F.col("_low")),
    })
    line = Window.partitionBy(*keys, blocks.BLOCK).orderBy(order)
    return counted.withColumns({
        "closed": F.col("closes") + F.col("low"),
        "depth": F.col("opened") - F.col("closes") - F.col("low"),
        "is_orphan": F.col("is_close") & (F.col("low") < F.coalesce(F.lag("low").over(line), F.col("_low0"))),
    }).drop("_o", "_x", "_low", "_o0", "_x0", "_low0", blocks.BLOCK)


def resolve_statements(messages: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Requests with their text: simple queries, and executions of the latest bind.

    An execution runs the statement its connection bound last: the latest Parse
    of that name, else (unnamed, or a name never parsed) the latest Parse of any
    name. Requests without text are left out.
    """
    steps = messages.where(_kind("Parse", "Bind", "Execute")).select(
        *_CONN, _ORDER, "captured_us", "kind", "statement_name", "query", "args")
    bound = blocks.last_before(steps, _CONN, _ORDER, {
        "_bind": (_kind("Bind"), F.struct("statement_name", "args")),
        "_latest": (_kind("Parse"), F.col("query")),
    }, block_rows)
    runs = materialize(bound.where(_kind("Execute")).select(
        *_CONN, _ORDER, "captured_us", F.lit(True).alias("run"),
        F.coalesce(F.col("_bind.statement_name"), F.lit("")).alias("name"),
        F.coalesce(F.col("_bind.args"), F.array().cast(_NO_TEXTS)).alias("args"), "_latest",
        F.lit(None).cast("string").alias("parsed"),
    ))
    # Unnamed statements are not in this list, so unnamed runs find nothing in it.
    parses = messages.where(_kind("Parse") & (F.col("statement_name") != "")).select(
        *_CONN, _ORDER, "captured_us", F.lit(False).alias("run"), F.col("statement_name").alias("name"),
        F.lit(None).cast(_NO_TEXTS).alias("args"), F.lit(None).cast("string").alias("_latest"),
        F.col("query").alias("parsed"),
    )
    executed = blocks.last_before(
        runs.unionByName(parses), [*_CONN, "name"], _ORDER, {"_named": (~F.col("run"), F.col("parsed"))}, block_rows,
    ).where("run").select(
        *_CONN, _ORDER, "captured_us", "args", F.coalesce("_named", "_latest").alias("query"), F.lit(True).alias("extended"))
    simple = messages.where(_kind("Query")).select(
        *_CONN, _ORDER, "captured_us", F.array().cast(_NO_TEXTS).alias("args"), "query", F.lit(False).alias("extended"))
    return executed.unionByName(simple).where(F.coalesce(F.col("query"), F.lit("")) != "")


def describe_results(messages: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Parameter types that the server reported, with the statement they were asked for.

    Describes and answers pair up in order between two Ready messages; answers
    without an open Describe are ignored.
    """
    rows = messages.where(_kind("Describe", "ParamDesc", "Ready")).select(*_CONN, _ORDER, "kind", "statement_name", "type_ids")
    epochs = blocks.running_sum(rows, _CONN, _ORDER, {"epoch": _kind("Ready").cast("int")}, block_rows)
    keys = [*_CONN, "epoch"]
    counted = fifo_counts(epochs.where(~_kind("Ready")), keys, _ORDER, _kind("Describe"), _kind("ParamDesc"), block_rows)
    ranked = counted.where(~F.col("is_orphan")).withColumn(
        "rank", F.when(F.col("is_open"), F.col("opened")).otherwise(F.col("closed")))
    pair = Window.partitionBy(*keys, "rank").orderBy(_ORDER)
    return ranked.withColumn("asked", F.lag("statement_name").over(pair)).where(_kind("ParamDesc")).select(
        *_CONN, _ORDER, F.col("asked").alias("statement_name"), "type_ids")


def resolve_param_types(messages: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Add to each Bind the parameter types in force: ``bind_types``.

    A named statement's own types win; otherwise the connection's latest types.
    """
    none = F.array().cast("array<bigint>")
    empty = F.lit(None).cast("array<bigint>")
    told = messages.where(_kind("Parse")).select(*_CONN, _ORDER, "statement_name", "type_ids", F.lit(True).alias("parse"))
    told = told.unionByName(materialize(describe_results(messages, block_rows)).withColumn("parse", F.lit(False)))
    binds = messages.where(_kind("Bind"))
    both = told.withColumn("bind", F.lit(False)).unionByName(
        binds.select(*_CONN, _ORDER, "statement_name", empty.alias("type_ids"), F.lit(False).alias("parse"), F.lit(True).alias("bind")))
    latest = blocks.last_before(both, _CONN, _ORDER, {
        "_latest": (~F.col("bind") & (F.col("parse") | (F.col("statement_name") == "")), F.col("type_ids")),
    }, block_rows)
    named = blocks.last_before(latest.where(F.col("statement_name") != ""), [*_CONN, "statement_name"], _ORDER, {
        "_named": (~F.col("bind"), F.col("type_ids"))}, block_rows)
    found = named.unionByName(latest.where(F.col("statement_name") == "").withColumn("_named", empty)).where("bind").select(
        *_CONN, _ORDER, F.coalesce("_named", "_latest", none).alias("bind_types"))
    return binds.join(found, [*_CONN, _ORDER])


def queue_scan(requests: DataFrame, replies: DataFrame, block_rows: int = 65536,
               max_pending: int | None = None) -> DataFrame:
    """Requests and server messages of each connection with the queue counters.

    Past ``max_pending`` open requests the capture of a connection's requests
    stops: the request that breaks the limit and all later ones are dropped,
    and the counters are restated for the rows after it (``breached``).
    """
    rows = requests.withColumn("kind", F.lit("Request")).unionByName(replies, allowMissingColumns=True)
    scanned = materialize(fifo_counts(
        rows, _CONN, _ORDER, _kind("Request"), _kind("Complete", "Error"), block_rows, last="captured_us"))
    # File statistics of ``depth`` answer this nearly for free where nothing breaches.
    too_many = F.col("is_open") & (F.col("depth") > max_pending) if max_pending is not None else F.lit(False)
    if max_pending is None or scanned.where(too_many).isEmpty():
        return scanned.withColumn("breached", F.lit(False))
    staged = blocks.with_block(scanned, _ORDER, block_rows)
    # The queue just before the first breach of each connection.
    state = F.struct(F.col(_ORDER).alias("at"), (F.col("opened") - 1).alias("opened"), "low")
    first = staged.where(too_many).groupBy(*_CONN).agg(F.min(state).alias("_first"))
    reached = (
        staged.select(*_CONN, blocks.BLOCK).distinct().join(first, _CONN)
        .where(F.col(blocks.BLOCK) + block_rows > F.col("_first.at"))
    )
    known = staged.join(reached, [*_CONN, blocks.BLOCK], "left").drop(blocks.BLOCK)
    # Nothing opens from there on, so the later lows follow from the closes alone.
    after = F.coalesce(F.col(_ORDER) >= F.col("_first.at"), F.lit(False))
    opened = F.col("_first.opened")
    low = F.least(F.col("_first.low"), opened - F.col("closes"))
    return known.withColumn("breached", after).where(~(after & F.col("is_open"))).withColumns({
        "is_orphan": F.when(after, F.col("is_close") & (opened - F.col("closes") < F.col("_first.low"))).otherwise(F.col("is_orphan")),
        "closed": F.when(after, F.col("closes") + low).otherwise(F.col("closed")),
        "depth": F.when(after, opened - F.col("closes") - low).otherwise(F.col("depth")),
        "opened": F.when(after, opened).otherwise(F.col("opened")),
    }).drop("_first")


def replies_of(messages: DataFrame, *kinds: str) -> DataFrame:
    """Server messages that take part in assembly."""
    wanted = [c for c in ("tag", "error", "columns", "cells", "cell_bytes") if c in messages.columns]
    return messages.where(_kind(*(kinds or ("Complete", "Error", "DataRow", "RowDesc")))).select(
        *_CONN, _ORDER, "captured_us", "kind", *wanted)


def scan_messages(messages: DataFrame, block_rows: int = 65536, max_pending: int | None = None,
                  with_responses: bool = True) -> DataFrame:
    """Messages -> requests and replies with queue counters.

    Requests and scan are written to the shared folder, because later steps read
    them several times.
    """
    kinds = ("Complete", "Error", "DataRow", "RowDesc") if with_responses else ("Complete", "Error")
    requests = materialize(resolve_statements(messages, block_rows))
    return queue_scan(requests, replies_of(messages, *kinds), block_rows, max_pending)


def pair_requests(scanned: DataFrame) -> DataFrame:
    """Close the k-th request of a connection by its k-th surviving completion.

    Requests left open end with the connection's last message. Each (connection,
    rank) pair holds two rows at most, so the shuffle is even whatever the keys.
    """
    ranked = scanned.where(F.col("is_open") | (F.col("is_close") & ~F.col("is_orphan"))).withColumn(
        "rank", F.when(F.col("is_open"), F.col("opened")).otherwise(F.col("closed")))
    pair = Window.partitionBy(*_CONN, "rank").orderBy(_ORDER)
    reply = F.lead(F.struct(_ORDER, "captured_us", "kind", "tag", "error")).over(pair)
    return ranked.withColumn("_reply", reply).where("is_open").select(
        *_CONN, "rank", _ORDER, "captured_us", "query", "args", "extended", "depth",
        F.col("_reply").isNotNull().alias("completed"),
        F.col(f"_reply.{_ORDER}").alias("completed_frame"),
        F.coalesce("_reply.captured_us", "key_last").alias("completed_us"),
        F.when(F.col("_reply").isNull(), F.lit(FLUSH_ERROR))
        .when(F.col("_reply.kind") == "Error", F.col("_reply.error")).otherwise("").alias("error"),
        F.when(F.col("_reply").isNull(), F.lit(FLUSH_TAG))
        .when(F.col("_reply.kind") == "Error", F.lit(ERROR_TAG)).otherwise(F.col("_reply.tag")).alias("status_tag"),
        F.when(F.col("_reply.kind") == "Complete", wire.rows_affected(F.col("_reply.tag"))).otherwise(0)
        .cast("bigint").alias("rows_affected"),
    )


def preview(rows: DataFrame, keys: Sequence[str], order: str, options: Options) -> DataFrame:
    """Totals and bounded preview of the rows of each response.

    ``rows`` has ``cells`` (array of text) and ``cell_bytes``. Kept is the
    longest prefix within the row and byte limits.
    """
    cells = F.transform("cells", lambda c: text.truncate_text(c, options.max_cell_chars))
    size = F.aggregate(cells, F.lit(0).cast("bigint"), lambda total, c: total + F.octet_length(c))
    # A row that breaks the byte limit by itself is never shown: only its size travels.
    narrow = rows.select(*keys, order, size.alias("_size"), cells.alias("_cells")).withColumn(
        "_cells", F.when(F.col("_size") <= options.max_preview_bytes, F.col("_cells")))
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("response_total_rows"), F.sum("cell_bytes").alias("response_total_bytes"))
    head = blocks.first_rows(narrow, keys, [order], options.max_preview_rows, "_at")
    upto = F.sum("_size").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    shown = (
        head.withColumn("_upto", upto).where(F.col("_upto") <= options.max_preview_bytes).groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_cells"))).alias("_kept"))
        .select(*keys, F.transform("_kept", lambda row: row["_cells"]).alias("response_rows"))
    )
    none = F.array().cast("array<array<string>>")
    return totals.join(shown, list(keys), "left").withColumn("response_rows", F.coalesce("response_rows", none)).withColumn(
        "response_truncated", F.size("response_rows") < F.col("response_total_rows"))


def attach_responses(scanned: DataFrame, options: Options) -> DataFrame:
    """Response of each request: messages go to the head of the queue when they arrive."""
    keys = [*_CONN, "rank"]
    arrived = scanned.where(_kind("DataRow", "RowDesc") & (F.col("depth") > 0)).withColumn("rank", F.col("closed") + 1)
    names = arrived.where(_kind("RowDesc")).groupBy(*keys).agg(F.max_by("columns", _ORDER).alias("columns")).select(
        *keys, F.transform("columns", lambda c: text.truncate_text(c, options.max_cell_chars)).alias("response_columns"))
    return preview(arrived.where(_kind("DataRow")), keys, _ORDER, options).join(names, keys, "full")


def apply_limits(events: DataFrame, options: Options) -> DataFrame:
    """Cut query and argument texts where the options ask for it."""
    out = events
    if options.max_query_chars is not None:
        out = out.withColumn("query", text.truncate_text(F.col("query"), options.max_query_chars))
    if options.max_arg_chars is not None:
        out = out.withColumn("args", F.transform("args", lambda a: text.truncate_text(a, options.max_arg_chars)))
    return out


def assign_sequence(events: DataFrame, *order: str) -> DataFrame:
    """Number events in completion order (any unique ``order``), from 1."""
    return number_rows(events, order, "sequence")


def assemble_events(messages: DataFrame, options: Options, with_responses: bool = True) -> DataFrame:
    """Decoded messages -> events, with transactions and ids but no sequence yet."""
    rows = options.block_rows
    scanned = scan_messages(messages, rows, options.max_pending, with_responses)
    paired = pair_requests(scanned)
    operation = text.infer_operation(F.col("query"), F.col("extended"))
    events = assign_transactions(paired.withColumn("operation", operation), _ORDER, rows).withColumns({
        "event_id": F.concat_ws("-", "connection_id", F.col("rank").cast("string")),
        "started_us": F.col("captured_us"),
        "duration_ms": (F.col("completed_us") - F.col("captured_us")) / F.lit(1000.0),
    })
    events = apply_limits(events, options)
    none = F.array().cast(_NO_TEXTS)
    if with_responses:
        events = events.join(attach_responses(scanned, options), [*_CONN, "rank"], "left")
    else:
        events = events.withColumns({
            "response_rows": F.lit(None).cast("array<array<string>>"), "response_columns": F.lit(None).cast(_NO_TEXTS),
            "response_total_rows": F.lit(None).cast("bigint"), "response_total_bytes": F.lit(None).cast("bigint"),
            "response_truncated": F.lit(None).cast("boolean"),
        })
    zero = F.lit(0).cast("bigint")
    return events.withColumns({
        "response_rows": F.coalesce("response_rows", F.array().cast("array<array<string>>")),
        "response_columns": F.coalesce("response_columns", none),
        "response_total_rows": F.coalesce("response_total_rows", zero),
        "response_total_bytes": F.coalesce("response_total_bytes", zero),
        "response_truncated": F.coalesce("response_truncated", F.lit(False)),
    })
