"""Streams against batch runs: files out of order, silent connections; limits that are off; times in other zones."""

import random

import pytest
from pyspark.sql import functions as F

from wirelens.functions import text, wire
from wirelens.operators import assemble, enrich
from wirelens.options import Options
from wirelens.sources import sinks
from wirelens.streaming import settled

SECOND = 1_000_000
ROWS = settled.NPlusOne.ROWS
MESSAGES = ("connection_id string, frame_no bigint, captured_us bigint, kind string, statement_name string, query string, args array<string>, "
            "type_ids array<bigint>, tag string, error string, columns array<string>, cells array<string>, cell_bytes bigint")


def message(connection, frame, at, kind, **fields):
    given = {"statement_name": "", "query": None, "args": None, "type_ids": None, "tag": None, "error": None, "columns": None, "cells": None, "cell_bytes": None} | fields
    return (connection, frame, at, kind, *given.values())


def feed(spark, tables, at, delay, step, batches, schema):
    sink = settled.Settling(tables, at, delay, step)
    for number, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), number)
    sink.finish(len(batches) - 1, spark.createDataFrame([], schema).schema)


def test_nplus1_out_of_order(spark, tmp_path):
    options = Options(nplus1_threshold=3, nplus1_window_s=1.0, nplus1_cooldown_s=2.0, block_seconds=2.0)
    rng, rows = random.Random(2), []
    for i in range(300):
        rows.append((rng.choice(["hot", "hot", "k1", "k2"]), "t", i, i * 90_000 + rng.randint(0, 3), rng.choice(["", "a", "b"])))
    hits = enrich.window_hits(spark.createDataFrame(rows, ROWS), options.window_us, options.block_us).withColumn("n_plus_1", enrich.is_match(3))
    wanted = sorted((r.sequence, r.n_plus_1_hits, r.n_plus_1_distinct_args, r.n_plus_1) for r in hits.collect())
    fired = {}
    alerts = []
    for scope, _, sequence, at, _ in sorted(rows, key=lambda r: r[3]):
        match = next(w for w in wanted if w[0] == sequence)[3]
        if match and (scope not in fired or at - fired[scope] >= 2 * SECOND):
            fired[scope] = at
            alerts.append(sequence)
    # Later files first, rows of a file mixed, all within the delay.
    parts = [rows[i:i + 60] for i in range(0, 300, 60)]
    order = [parts[1], parts[0], parts[3], parts[2], parts[4]]
    for part in order:
        rng.shuffle(part)
    tables = settled.Tables(spark, str(tmp_path / "n"))
    feed(spark, tables, "started_us", 12 * SECOND, settled.NPlusOne(tables, options), order, ROWS)
    found = tables.all("hits").collect()
    assert sorted((r.sequence, r.n_plus_1_hits, r.n_plus_1_distinct_args, r.n_plus_1) for r in found) == wanted
    assert sorted(r.sequence for r in found if r.alert) == sorted(alerts)


def conversation():
    rows, frame = [], 0

    def say(kind, at, **fields):
        nonlocal frame
        frame += 1
        rows.append(message("c1", frame, at * SECOND, kind, **fields))

    say("Parse", 1, statement_name="s", query="select 1 where a = $1", type_ids=[23])
    say("Query", 2, query="BEGIN")
    say("Complete", 3, tag="BEGIN")
    say("Bind", 4, statement_name="s", args=["7"])
    say("Execute", 5)
    say("Query", 6, query="update t set a = 1")
    say("DataRow", 7, cells=["x"], cell_bytes=1)
    say("Complete", 8, tag="SELECT 1")
    say("Complete", 20, tag="UPDATE 4")
    say("Query", 21, query="COMMIT")
    say("Error", 22, error="no")
    say("Execute", 23)
    say("Complete", 24, tag="SELECT 0")
    say("Query", 25, query="select 'left open'")
    return rows


def events_of(frame):
    return sorted((r.event_id, r.query, tuple(r.args), r.tx_id, r.status_tag, r.error, r.started_us, r.completed_us, r.response_total_rows) for r in frame.collect())


@pytest.mark.parametrize("size", [4, 20])
def test_assembly_in_pieces(spark, tmp_path, size):
    options, rows = Options(), conversation()
    batch = assemble.assemble_events(spark.createDataFrame(rows, MESSAGES), options)
    wanted = events_of(batch.where("completed"))
    pieces = [rows[i:i + size] for i in range(0, len(rows), size)]
    if size == 4:
        pieces[0], pieces[1] = pieces[1], pieces[0]
    tables = settled.Tables(spark, str(tmp_path / "a"))
    feed(spark, tables, "captured_us", 8 * SECOND, settled.Assembly(tables, options, 3600 * SECOND), pieces, MESSAGES)
    assert events_of(tables.all("events")) == wanted


def test_ids_go_on_after_silence(spark, tmp_path):
    first = [message("c1", 1, SECOND, "Query", query="BEGIN"), message("c1", 2, 2 * SECOND, "Complete", tag="BEGIN"), message("c1", 3, 3 * SECOND, "Query", query="select 1")]
    other = [message("c2", 4, 500 * SECOND, "Query", query="select 2"), message("c2", 5, 501 * SECOND, "Complete", tag="SELECT 1")]
    again = [message("c1", 6, 502 * SECOND, "Query", query="BEGIN"), message("c1", 7, 503 * SECOND, "Complete", tag="BEGIN")]
    tables = settled.Tables(spark, str(tmp_path / "i"))
    feed(spark, tables, "captured_us", SECOND, settled.Assembly(tables, Options(), 60 * SECOND), [first, other, again], MESSAGES)
    found = {r.event_id: (r.status_tag, r.tx_id) for r in tables.all("events").collect()}
    assert found == {"c1-1": ("BEGIN", "c1:1"), "c1-2": ("DISCONNECTED", "c1:1"), "c2-1": ("SELECT 1", ""), "c1-3": ("BEGIN", "c1:2")}


def test_nothing_is_dropped_by_default(spark, capsys):
    n = 2000
    long = "x" * 1500
    rows = [message("c", i, i, "Query", query=f"select '{long}{i}'") for i in range(n)] + [message("c", n + i, n + i, "Complete", tag="SELECT 1") for i in range(n)]
    events = assemble.assemble_events(spark.createDataFrame(rows, MESSAGES), Options(block_rows=256))
    assert events.where("completed").count() == n
    assert events.select("query").distinct().count() == n
    whole = events.limit(100).withColumns({"sequence": F.col("rank"), "slow": F.lit(False), "n_plus_1": F.lit(False), "n_plus_1_hits": F.lit(0), "n_plus_1_distinct_args": F.lit(0)})
    sinks.print_events(whole)
    assert len([x for x in capsys.readouterr().out.splitlines() if x.startswith("[")]) == 100


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_in_other_zones(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = spark.createDataFrame([(0,), (-1,), (1_710_055_800_123_456,)], "us bigint")
        rows = times.orderBy("us").select(text.iso_time(F.col("us")), text.clock_time_ms(F.col("us")), wire.pg_timestamp(F.col("us"))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r) for r in rows] == [
        ("1969-12-31T23:59:59.999999+00:00", "23:59:59.999", "1999-12-31T23:59:59.999999+00:00"),
        ("1970-01-01T00:00:00+00:00", "00:00:00.000", "2000-01-01T00:00:00+00:00"),
        ("2024-03-10T07:30:00.123456+00:00", "07:30:00.123", "2054-03-10T07:30:00.123456+00:00")]


def test_long_lists_are_linear(spark):
    body = b"".join((2).to_bytes(4, "big") + b"ab" for _ in range(16_000))
    row = spark.createDataFrame([(bytearray((16_000).to_bytes(2, "big") + body),)], "payload binary")
    assert row.select(F.size(wire.decode_data_row(F.col("payload")))).first()[0] == 16_000
