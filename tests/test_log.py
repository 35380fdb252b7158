"""The tables of a stream: what each batch writes, what is read of it, and what is removed."""

import os

import pytest

from wirelens.operators import enrich
from wirelens.options import Options
from wirelens.streaming import settled
from wirelens.streaming.log import KeyState, Tables, TimeLog, whole_buckets

SECOND = 1_000_000
ROWS = "key string, at bigint, n bigint"


class Keep:
    """A step that only remembers what it got."""

    lookback_us = 5

    def __init__(self):
        self.calls = []

    def __call__(self, rows, before, mark, number, earlier):
        self.calls.append((sorted(r.n for r in rows.collect()), before, mark, number, sorted(r.n for r in earlier(5).collect())))


def folders(path):
    return sorted(f"{d.split('batch=')[1]}" for d, _, names in os.walk(path) if any(n.endswith(".parquet") for n in names) and "_bucket=" in d)


def test_rows_are_written_once_and_buckets_settle_in_order(spark, tmp_path):
    keep, tables = Keep(), Tables(spark, str(tmp_path))
    sink = settled.Settling(tables, "at", 20, keep, bucket_us=10)
    batches = [[3, 12, 25], [1, 14, 38], [44, 22, 9], [29, 55], [95], [96]]
    written = []
    for number, times in enumerate(batches):
        sink(spark.createDataFrame([("k", t, t) for t in times], ROWS), number)
        written.append(spark.read.parquet(f"{tmp_path}/log/batch={number}").count() if number < 3 else None)
    sink.finish(5, spark.createDataFrame([], ROWS).schema)
    # Late rows (1 after the mark at -1 is not late; 9 and 22 behind later marks are).
    assert whole_buckets(25, 20, 10) == -1 and whole_buckets(38, 20, 10) == 9
    assert keep.calls == [
        ([], None, -1, 0, []), ([1, 3], -1, 9, 1, []), ([12, 14], 9, 19, 2, []), ([22, 25, 29], 19, 29, 3, []),
        ([38, 44, 55], 29, 69, 4, [25, 29]), ([95, 96], 69, None, 5, [])]
    assert written[:3] == [3, 3, 2]
    # Buckets that went off the list two batches ago are removed.
    assert folders(f"{tmp_path}/log") and not [f for f in folders(f"{tmp_path}/log") if f.endswith(("=0", "=1"))]


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    log = TimeLog(tables, "log", "at", 10)
    schema = spark.createDataFrame([], ROWS).schema
    for again in range(2):
        newest, parts = log.append(spark.createDataFrame([("a", 5, 1), ("a", 15, 2), ("a", None, 3)], ROWS), 0)
        log.forget(parts, 10, 0)
    assert newest == 15 and log.parts(1).live == [(0, 1)]
    for again in range(2):
        _, parts = log.append(spark.createDataFrame([("b", 17, 4), ("b", -3, 5)], ROWS), 1)
        log.forget(parts, None, 1)
    assert sorted(parts.live) == [(0, 1), (1, -1), (1, 1)]
    assert sorted(r.n for r in log.read(parts, 10, 16, schema).collect()) == [2]
    assert sorted(r.n for r in log.read(parts, None, None, schema).collect()) == [2, 4, 5]


def test_state_expires_by_age(spark, tmp_path):
    state = KeyState(Tables(spark, str(tmp_path)), "s", ["key"], ROWS, "at", ttl_us=100, merge_every=4)
    held = []
    for batch in range(20):
        now = batch * 50
        rows = [(f"k{batch}", now, batch), ("always", now, batch)] + ([("back", now, batch)] if batch in (0, 12) else [])
        state.change(spark.createDataFrame(rows, ROWS), batch, now)
        alive = {r.key: r.n for r in state.read(batch + 1, now).collect()}
        assert alive["always"] == batch and f"k{batch}" in alive
        assert set(alive) == {"always", *(f"k{b}" for b in range(batch + 1) if b * 50 > now - 100)} | ({"back"} if batch in (0, 1, 12, 13) else set())
        held.append(state.rows_held(batch + 1))
    # Keys of the last 100, and the changes since the last merge, whatever went before.
    assert max(held) <= 4 + 3 * 4
    assert len(os.listdir(tmp_path / "s")) <= 9


def test_streamed_events_equal_batch(spark, tmp_path):
    options = Options(nplus1_threshold=3, nplus1_window_s=1.0, nplus1_cooldown_s=2.0, slow_ms=50)
    rows = [(i, i * 90_000, f"c{i % 3 % 2}", "Query" if i % 4 else "Exec", f"select a from t where id = {i % 5}", [str(i % 3)] if i % 2 else [], "" if i % 7 else "bad", float(i % 100), "", "") for i in range(200)]
    schema = ("sequence bigint, started_us bigint, connection_id string, operation string, query string, args array<string>, error string, duration_ms double, tx_id string, status_tag string")
    events = spark.createDataFrame(rows, schema)
    want = enrich.enrich(events, options).withColumn("status", settled.text.event_status())
    names = ["sequence", "slow", "n_plus_1_hits", "n_plus_1_distinct_args", "n_plus_1", "status"]
    tables = Tables(spark, str(tmp_path))
    step = settled.Enrichment(tables, options)
    sink = settled.Settling(tables, "started_us", 12 * SECOND, step)
    parts = [rows[60:120], rows[:60], rows[120:160], rows[160:]]
    for number, part in enumerate(parts):
        sink(settled.Enrichment.rows(spark.createDataFrame(part, schema), options), number)
    sink.finish(len(parts) - 1, settled.Enrichment.rows(events, options).schema)
    got = tables.all("events").select(*names)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.select(*names).collect())
    assert any(r.status.startswith("N+1") for r in got.collect())


@pytest.mark.parametrize("size", [7, 100])
def test_lives_of_keys(spark, tmp_path, size):
    times = [0, 3, 8, 19, 20, 45, 46, 47, 80, 81, 95, 140]
    rows = [(k, t) for k in ("a", "b") for t in times if k == "a" or t % 2] + [("c", 60)]
    wanted = set()
    for key in ("a", "b", "c"):
        life = []
        for t in [t for k, t in rows if k == key] + [10**9]:
            if life and t - life[-1] > 10:
                wanted.add((key, life[0], life[-1], len(life)))
                life = []
            life.append(t)
    tables = Tables(spark, str(tmp_path))
    step = settled.KeyLives(tables, ["key"], "key string", "at", 10)
    sink = settled.Settling(tables, "at", 5, step, bucket_us=5)
    ordered = sorted(rows, key=lambda r: r[1])
    parts = [ordered[i:i + size] for i in range(0, len(ordered), size)]
    for number, part in enumerate(parts):
        sink(spark.createDataFrame(part, "key string, at bigint"), number)
    sink.finish(len(parts) - 1, spark.createDataFrame([], "key string, at bigint").schema)
    assert {(r.key, r.life_us, r.last_us, r.rows) for r in step.lives().collect()} == wanted
