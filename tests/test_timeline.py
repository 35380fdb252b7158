"""The grouped list: headers over their transactions, and only events of a transaction look for one."""

from wirelens.operators import blocks, timeline

NAMES = ("sequence bigint, tx_id string, connection_id string, query string, duration_ms double, started_us bigint, "
         "rows_affected bigint, error string, slow boolean, n_plus_1 boolean")


def event(sequence, tx, query="q"):
    return (sequence, tx, "c1", query, 1.0, (sequence or 0) * 1000, 0, "", False, False)


def test_grouped_list(spark, monkeypatch):
    rows = [event(1, ""), event(2, "c1:1", "BEGIN"), event(3, None), event(9, "c1:1", "x"), event(5, ""), event(5, ""), event(6, "c1:2", "y"), event(None, "c1:2", "z")]
    events = spark.createDataFrame([(*r, "wide") for r in rows], NAMES + ", extra string")
    placed, with_block = [], blocks.with_block

    def count(df, order, size):
        if "query" in df.columns:
            placed.append(df.count())
        return with_block(df, order, size)

    monkeypatch.setattr(blocks, "with_block", count)
    found = [(r["kind"], r["group_key"], r["sequence"], r["tx_id"], r["query"], r["event_count"]) for r in timeline.grouped_list(events, 4).collect()]
    assert found == [
        ("event", None, None, "c1:2", "z", 1), ("event", 1, 1, "", "q", 1),
        ("tx", 2, 2, "c1:1", "BEGIN; x", 2), ("event", 2, 2, "c1:1", "BEGIN", 1), ("event", 2, 9, "c1:1", "x", 1),
        ("event", 3, 3, None, "q", 1), ("event", 5, 5, "", "q", 1), ("event", 5, 5, "", "q", 1),
        ("tx", 6, 6, "c1:2", "z; y", 2), ("event", 6, 6, "c1:2", "y", 1)]
    # The events that are shown, and those that pairs of transaction and block are taken from.
    assert sorted(placed) == [4, 4]
