"""Streams whose rows must be taken in order: held until nothing earlier can come, then run as batches.

Every batch is first appended to a log of time buckets in the shared folder (``log``),
each row once. The mark is the end of the last bucket that the newest time has left
behind by the delay; once it moves, the buckets it has passed are settled: all their
predecessors are there, whatever order the files came in. A batch that moves no mark
only appends. A step gets the settled rows, and as much of the log before them as it
asks for, and computes with the same block scans as batch jobs, so a long key is
split over tasks here too. Steps are numbered; one that is tried again writes the same
folders again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from ..operators import assemble, blocks, cooldown
from ..operators.enrich import add_basics, candidates, is_match, window_hits
from ..operators.materialize import materialize
from ..operators.transactions import assign_transactions
from ..options import Options
from .log import KeyState, Tables, TimeLog, whole_buckets

_KEY = ["n_plus_1_scope", "normalized_query"]
_CONN = ["connection_id"]
_ORDER = "frame_no"
_MARK = "at bigint, steps bigint"

# Rows of the log that lie up to so long before the settled ones.
Earlier = Callable[[int], DataFrame]


class Step(Protocol):
    """Takes settled rows; they lie behind ``before`` and up to ``mark`` (None: no bound). ``lookback_us``: how much of the log before them it asks for."""

    lookback_us: int

    def __call__(self, rows: DataFrame, before: int | None, mark: int | None, number: int, earlier: Earlier) -> None: ...


class Settling:
    """A sink that hands rows on in the order of their time, ``delay_us`` behind the newest.

    Rows that come later than that are dropped, as behind any watermark. ``bucket_us`` is
    the span of the log's folders, and by how much settling may lag further.
    """

    def __init__(self, tables: Tables, at: str, delay_us: int, step: Step, bucket_us: int | None = None) -> None:
        self.tables, self.at, self.delay_us, self.step = tables, at, delay_us, step
        self.bucket_us = bucket_us or max(1, delay_us // 8)
        self.log = TimeLog(tables, "log", at, self.bucket_us)

    def _mark(self, batch: int) -> tuple[int | None, int]:
        row = self.tables.before("mark", batch, _MARK).first()
        return (None, 0) if row is None else (row["at"], row["steps"])

    def _settle(self, parts, schema: object, before: int | None, mark: int | None, number: int) -> None:
        def earlier(span_us: int) -> DataFrame:
            if before is None:
                return self.tables.spark.createDataFrame([], schema)
            return self.log.read(parts, before - span_us, before, schema)

        self.step(self.log.read(parts, before, mark, schema), before, mark, number, earlier)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        before, steps = self._mark(batch)
        newest, parts = self.log.append(rows if before is None else rows.where(F.col(self.at) > before), batch)
        mark = before
        if newest is not None:
            reached = whole_buckets(newest, self.delay_us, self.bucket_us)
            mark = reached if before is None else max(reached, before)
        if mark != before:
            self._settle(parts, rows.schema, before, mark, steps)
            steps += 1
        self.log.forget(parts, None if mark is None else mark - self.step.lookback_us, batch)
        self.tables.write("mark", self.tables.spark.createDataFrame([(mark, steps)], _MARK).coalesce(1), batch)
        if batch >= 2:
            self.tables.drop("mark", batch - 2)

    def finish(self, last: int, schema: object) -> None:
        """The stream has ended: what is still held is settled as well."""
        before, steps = self._mark(last + 1)
        self._settle(self.log.parts(last + 1), schema, before, None, steps)


class NPlusOne:
    """Hits, verdict and alert of every candidate event.

    The last window before the settled rows is read from the log. The last alert of
    each key is state that expires by age: one that lies a cooldown behind can't hold
    back another, so a key that falls silent leaves nothing behind.
    """

    ROWS = "n_plus_1_scope string, normalized_query string, sequence bigint, started_us bigint, signature string"
    FIRED = "n_plus_1_scope string, normalized_query string, at bigint"

    def __init__(self, tables: Tables, options: Options) -> None:
        self.tables, self.options, self.lookback_us = tables, options, options.window_us
        self.fired = KeyState(tables, "fired", _KEY, self.FIRED, "at", options.cooldown_us)

    @staticmethod
    def rows(events: DataFrame, options: Options) -> DataFrame:
        """What the step needs of each candidate event of a stream."""
        return candidates(add_basics(events, options))

    def verdicts(self, rows: DataFrame, earlier: DataFrame, before: int | None, number: int) -> DataFrame:
        """Write and give hits, verdict and alert of the settled ones among candidates."""
        options, tables = self.options, self.tables
        hits = window_hits(rows.unionByName(earlier), options.window_us, options.block_us)
        fresh = materialize((hits if before is None else hits.where(F.col("started_us") > before)).withColumn("n_plus_1", is_match(options.nplus1_threshold)))
        last = self.fired.read(number, before).withColumnRenamed("at", "_fired")
        # The chain of alerts goes on at the first match one cooldown after the last.
        open_ = fresh.where("n_plus_1").join(last, _KEY, "left").where(
            F.coalesce(F.col("started_us") - F.col("_fired") >= options.cooldown_us, F.lit(True))).drop("_fired")
        alerts = materialize(cooldown.fired(open_, _KEY, "started_us", "sequence", options.cooldown_us))
        self.fired.change(alerts.groupBy(*_KEY).agg(F.max("at").alias("at")), number, before)
        marked = fresh.join(alerts.select(F.col("seq").alias("sequence"), F.lit(True).alias("alert")), "sequence", "left")
        tables.write("hits", marked.withColumn("alert", F.coalesce("alert", F.lit(False))), number)
        return tables.read("hits", [number], marked.schema)

    def __call__(self, rows: DataFrame, before: int | None, mark: int | None, number: int, earlier: Earlier) -> None:
        self.verdicts(rows, earlier(self.options.window_us), before, number)


class Enrichment(NPlusOne):
    """Whole events with template, slow flag, N+1 figures and status, equal to those of a batch job.

    The log holds events with the columns that depend on the row alone; detection reads
    the narrow ones of candidates, and its verdicts are joined to the settled events by
    their sequence, which is unique.
    """

    @staticmethod
    def rows(events: DataFrame, options: Options) -> DataFrame:
        return add_basics(events, options)

    def __call__(self, rows: DataFrame, before: int | None, mark: int | None, number: int, earlier: Earlier) -> None:
        found = self.verdicts(candidates(rows), candidates(earlier(self.options.window_us)), before, number)
        none = F.lit(0).cast("bigint")
        joined = rows.join(found.select("sequence", "n_plus_1_hits", "n_plus_1_distinct_args", "n_plus_1", "alert"), "sequence", "left").withColumns({
            "n_plus_1_hits": F.coalesce("n_plus_1_hits", none), "n_plus_1_distinct_args": F.coalesce("n_plus_1_distinct_args", none),
            "n_plus_1": F.coalesce("n_plus_1", F.lit(False)), "alert": F.coalesce("alert", F.lit(False))})
        self.tables.write("events", joined.withColumn("status", text.event_status()), number)


class KeyLives:
    """Lives of keys: a key that is silent for longer than ``ttl_us`` is forgotten, and begins anew when it comes back.

    The state has one row a key, its life and when it was last seen, and expires by
    age. Within a step, rows are first folded to blocks as long as ``ttl_us`` (two rows
    in one block belong to one life), so the scan along a key sees one row a block.
    """

    LIFE = "life_us bigint, last_us bigint"

    def __init__(self, tables: Tables, keys: list[str], schema: str, at: str, ttl_us: int) -> None:
        self.tables, self.keys, self.at, self.ttl_us, self.lookback_us = tables, keys, at, ttl_us, 0
        self.state = KeyState(tables, "lives_state", keys, f"{schema}, {self.LIFE}", "last_us", ttl_us)

    def __call__(self, rows: DataFrame, before: int | None, mark: int | None, number: int, earlier: Earlier) -> None:
        placed = blocks.with_block(rows, self.at, self.ttl_us)
        folded = placed.groupBy(*self.keys, blocks.BLOCK).agg(F.min(self.at).alias("_first"), F.max(self.at).alias("_last"), F.count(F.lit(1)).alias("_rows"), F.lit(None).cast("bigint").alias("_life"))
        known = self.state.read(number, before).select(*self.keys, F.lit(-1).cast("bigint").alias(blocks.BLOCK), F.col("last_us").alias("_first"), F.col("last_us").alias("_last"),
                                                       F.lit(0).cast("bigint").alias("_rows"), F.col("life_us").alias("_life"))
        along = blocks.Window.partitionBy(*self.keys).orderBy("_first", "_rows")
        previous = F.lag("_last").over(along)
        begun = folded.unionByName(known).withColumn("_born", F.when(F.col("_life").isNotNull(), F.col("_life")).when(F.coalesce(F.col("_first") - previous > self.ttl_us, F.lit(True)), F.col("_first")))
        lives = begun.withColumn("life_us", F.last("_born", ignorenulls=True).over(along.rowsBetween(blocks.Window.unboundedPreceding, 0)))
        found = materialize(lives.where("_rows > 0").groupBy(*self.keys, "life_us").agg(F.max("_last").alias("last_us"), F.sum("_rows").alias("rows")))
        self.tables.write("lives", found, number)
        newest = found.groupBy(*self.keys).agg(F.max(F.struct("life_us", "last_us")).alias("_row"))
        self.state.change(newest.select(*self.keys, "_row.life_us", "_row.last_us"), number, before)

    def lives(self) -> DataFrame:
        """Every life so far: its keys, begin (life_us), end (last_us) and rows."""
        return self.tables.all("lives").groupBy(*self.keys, "life_us").agg(F.max("last_us").alias("last_us"), F.sum("rows").alias("rows"))


class Assembly:
    """Events of a message stream.

    Carried are, for each connection: messages from its first open request on (of the
    server's only those behind the last reply that closed one), the latest Parse of
    each name and the latest Bind before that, and one line with the number of
    requests and transactions so far, the open transaction and the last time. Ids
    therefore go on where they were, also after a connection was closed as silent.
    """

    LINE = "connection_id string, requests bigint, transactions bigint, inside boolean, last_us bigint"

    def __init__(self, tables: Tables, options: Options, idle_us: int) -> None:
        self.tables, self.options, self.idle_us, self.lookback_us = tables, options, idle_us, 0
        self.lines = KeyState(tables, "line", _CONN, self.LINE)

    def __call__(self, rows: DataFrame, before: int | None, mark: int | None, batch: int, earlier: Earlier) -> None:
        tables, width = self.tables, self.options.block_rows
        schema = rows.schema
        messages = materialize(rows.unionByName(tables.before("open", batch, schema)).unionByName(tables.before("names", batch, schema)))
        line = materialize(self.lines.read(batch))
        scanned = assemble.scan_messages(messages, width, self.options.max_pending)
        paired = assemble.pair_requests(scanned).withColumn("operation", text.infer_operation(F.col("query"), F.col("extended")))
        # An open transaction is told by a BEGIN before everything else.
        begin = line.where("inside").select(
            "connection_id", F.lit(-1).cast("bigint").alias(_ORDER), F.lit("BEGIN").alias("query"), F.lit("BEGIN").alias("operation"))
        numbered = assign_transactions(paired.unionByName(begin, allowMissingColumns=True), _ORDER, width).where(F.col(_ORDER) >= 0)
        known = numbered.join(line.withColumnRenamed("last_us", "_last"), _CONN, "left")
        number = F.element_at(F.split("tx_id", ":"), -1).cast("bigint") + F.coalesce("transactions", F.lit(0)) - F.coalesce(F.col("inside").cast("bigint"), F.lit(0))
        events = materialize(known.withColumns({
            "tx_id": F.when(F.col("tx_id") == "", "").otherwise(F.concat_ws(":", "connection_id", number.cast("string"))),
            "_number": F.when(F.col("tx_id") != "", number), "_local": F.col("rank"),
            "rank": F.col("rank") + F.coalesce("requests", F.lit(0)),
        }).drop("requests", "transactions", "inside", "_last"))

        times = messages.groupBy(*_CONN).agg(F.max("captured_us").alias("last_us"))
        last = line.select("connection_id", "last_us").unionByName(times).groupBy(*_CONN).agg(F.max("last_us").alias("last_us"))
        silent = F.lit(False) if mark is None else F.col("last_us") < mark - self.idle_us
        state = last.withColumn("silent", silent)
        # Where each connection's open requests begin, and behind which frame replies are still to be used.
        cut = events.groupBy(*_CONN).agg(F.min(F.when(~F.col("completed"), F.col(_ORDER))).alias("_first"), F.max("completed_frame").alias("_closed"))
        cut = materialize(state.join(cut, _CONN, "left").withColumn("_first", F.when(~F.col("silent"), F.col("_first"))))

        placed = events.join(cut.drop("last_us"), _CONN).withColumn("_done", F.col("completed") | F.col("silent"))
        tables.write("events", self._finished(placed, scanned), batch)

        settled = placed.where(F.col("_first").isNull() | (F.col(_ORDER) < F.col("_first")))
        ended = F.col("operation").isin("COMMIT", "ROLLBACK") | (F.col("tx_id") == "")
        moved = settled.groupBy(*_CONN).agg(
            F.count(F.lit(1)).alias("_requests"), F.max("_number").alias("_transactions"), F.max_by(~ended, _ORDER).alias("_inside"))
        was = line.select("connection_id", F.struct("requests", "transactions", "inside", "last_us").alias("_was"))
        after = cut.join(line.drop("last_us"), _CONN, "left").join(was, _CONN, "left").join(moved, _CONN, "left").select(
            "connection_id", "_was", (F.coalesce("requests", F.lit(0)) + F.coalesce("_requests", F.lit(0))).alias("requests"),
            F.greatest(F.coalesce("transactions", F.lit(0)), F.coalesce("_transactions", F.lit(0))).alias("transactions"),
            (~F.col("silent") & F.coalesce("_inside", "inside", F.lit(False))).alias("inside"), "last_us")
        # A connection whose line is as it was writes nothing.
        self.lines.change(after.where(~F.col("_was").eqNullSafe(F.struct("requests", "transactions", "inside", "last_us"))), batch)

        asked = F.col("kind").isin("Query", "Parse", "Bind", "Describe", "Execute")
        marked = messages.join(cut.where(~F.col("silent")).drop("last_us", "silent"), _CONN)
        tables.write("open", marked.where(F.col("_first").isNotNull() & F.when(asked, F.col(_ORDER) >= F.col("_first")).otherwise(
            F.col(_ORDER) > F.coalesce("_closed", F.lit(-1)))).select(*messages.columns), batch)
        earlier = marked.where(F.col("kind").isin("Parse", "Bind") & (F.col("_first").isNull() | (F.col(_ORDER) < F.col("_first"))))
        whole = F.struct(*messages.columns)
        name = F.when(F.col("kind") == "Parse", F.coalesce("statement_name", F.lit("")))
        latest = earlier.groupBy("connection_id", "kind", name.alias("_name")).agg(F.max_by(whole, _ORDER).alias("row"))
        tables.write("names", latest.select("row.*"), batch)
        for name in ("open", "names"):
            if batch >= 2:
                tables.drop(name, batch - 2)

    def _finished(self, placed: DataFrame, scanned: DataFrame) -> DataFrame:
        """Events of closed requests, and of those that a silent connection left open."""
        options = self.options
        responses = assemble.attach_responses(scanned, options).withColumnRenamed("rank", "_local")
        events = placed.where("_done").join(responses, [*_CONN, "_local"], "left")
        zero = F.lit(0).cast("bigint")
        return assemble.apply_limits(events, options).select(
            "connection_id", "rank", _ORDER, F.concat_ws("-", "connection_id", F.col("rank").cast("string")).alias("event_id"), "operation", "query", "args",
            F.col("captured_us").alias("started_us"), "completed_us", ((F.col("completed_us") - F.col("captured_us")) / F.lit(1000.0)).alias("duration_ms"),
            "rows_affected", "error", "tx_id", "status_tag", F.coalesce("response_columns", F.array().cast("array<string>")).alias("response_columns"),
            F.coalesce("response_rows", F.array().cast("array<array<string>>")).alias("response_rows"), F.coalesce("response_total_rows", zero).alias("response_total_rows"),
            F.coalesce("response_total_bytes", zero).alias("response_total_bytes"), F.coalesce("response_truncated", F.lit(False)).alias("response_truncated"))
