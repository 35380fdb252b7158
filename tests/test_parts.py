"""Streams fed from a table: batches by time whatever the number of tasks, files of a bounded size, nothing dropped as late."""

from pyspark.sql import functions as F

from wirelens.plans import sink_queries
from wirelens.streaming import streams

DAY = sink_queries.DAY_US


def test_parts_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink_queries, "PART_ROWS", 50, raising=False)
    rows = [(i, (i * 7 % 600) * DAY // 20, "x") for i in range(600)] + [(600, 30 * DAY, "last"), (601, None, "none"), (601, None, "none")]
    table = spark.createDataFrame(rows, "sequence bigint, at bigint, q string").repartition(8)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    batches, files = [], []

    def keep(batch, number):
        batches.append([tuple(r) for r in batch.collect()])
        files.extend(r["count"] for r in batch.groupBy(F.input_file_name()).count().collect())

    def count(tables):
        def step(rows, before, mark, number, earlier):
            tables.write("rows", rows, number)

        step.lookback_us = 0
        return step

    try:
        streams.run_available(sink_queries._in_parts(spark, table, "at", "sequence"), str(tmp_path / "progress"), keep)
        settled_rows = sink_queries._settled(spark, sink_queries._in_parts(spark, table, "at", "sequence"), "at", count).all("rows").count()
        none = sink_queries._in_parts(spark, table.limit(0), "at", "sequence")
        assert streams.run_available(none, str(tmp_path / "none"), lambda batch, number: batches.append([tuple(r) for r in batch.collect()])) <= 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    batches = [b for b in batches if b]
    assert sorted((r for b in batches for r in b), key=repr) == sorted(rows, key=repr)
    assert [{None if r[1] is None else r[1] // (5 * DAY) for r in b} for b in batches] == [{None}, {0}, {1}, {2}, {3}, {4}, {5}, {6}]
    assert max(files) < 100
    assert settled_rows == 601


def test_detection_streams_only_what_it_reads(spark, monkeypatch):
    row = (1, 5, 2.0, "c1", "", "Query", "SELECT 1 FROM t WHERE id = 7", ["a"], [["wide"]], "SELECT 1")
    names = "sequence bigint, started_us bigint, duration_ms double, connection_id string, tx_id string, operation string, query string, args array<string>, response_rows array<array<string>>, status_tag string"
    events = spark.createDataFrame([row, (2, *row[1:6], "SELECT 2", None, *row[8:])], names)
    seen = []

    def whole(spark, rows, at, order):
        seen.extend(rows.columns)
        return rows

    class Ended:
        def __init__(self, rows):
            self.all = lambda name: rows

    monkeypatch.setattr(sink_queries, "trace_tx", lambda spark, folder: events)
    monkeypatch.setattr(sink_queries, "_in_parts", whole)
    monkeypatch.setattr(sink_queries, "_settled", lambda spark, rows, at, make: Ended(rows))
    found = sink_queries._nplus1(spark, "")
    assert not {"response_rows", "status_tag"} & set(seen)
    wanted = sink_queries.settled.NPlusOne.rows(events, sink_queries.TRACE)
    assert found.columns == wanted.columns and sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))


def test_enrichment_streams_only_what_it_reads(spark, monkeypatch):
    row = (1, 5, 200.0, "c1", "", "Query", "SELECT 1 FROM t WHERE id = 7", ["a"], "bad", [["wide"]], "SELECT 1")
    names = "sequence bigint, started_us bigint, duration_ms double, connection_id string, tx_id string, operation string, query string, args array<string>, error string, response_rows array<array<string>>, status_tag string"
    events = spark.createDataFrame([row, (2, *row[1:6], "SELECT 2", None, "", *row[9:])], names)
    seen = []

    def whole(spark, rows, at, order):
        seen.extend(rows.columns)
        return rows

    class Ended:
        def __init__(self, rows):
            self.all = lambda name: rows

    monkeypatch.setattr(sink_queries, "trace_tx", lambda spark, folder: events)
    monkeypatch.setattr(sink_queries, "_in_parts", whole)
    monkeypatch.setattr(sink_queries, "_settled", lambda spark, rows, at, make: Ended(rows))
    found = sink_queries._enriched(spark, "")
    assert seen and not {"response_rows", "status_tag"} & set(seen)
    wanted = sink_queries.settled.Enrichment.rows(events, sink_queries.TRACE).select(*found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
