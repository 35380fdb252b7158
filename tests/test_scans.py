"""Blocked scans against plain queues and loops, over many block sizes and one hot key."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wirelens.operators import analytics, assemble, blocks, cooldown, enrich, timeline
from wirelens.options import Options


def hot_keys(rng, n):
    """A third of the rows belong to one key."""
    return ["hot" if rng.random() < 0.34 else f"k{rng.randint(0, 9)}" for _ in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_fifo_counts_match_a_queue(spark, size):
    rng = random.Random(size)
    rows = [(k, i, rng.choice(["open", "open", "close", "close", "other"])) for i, k in enumerate(hot_keys(rng, 600))]
    found = assemble.fifo_counts(
        spark.createDataFrame(rows, "k string, n bigint, kind string"), ["k"], "n",
        F.col("kind") == "open", F.col("kind") == "close", size).collect()
    seen = {(r.k, r.n): (r.opened, r.closed, r.depth, r.is_orphan) for r in found}
    queues, opened, closed = {}, {}, {}
    for k, n, kind in rows:
        queue, orphan = queues.setdefault(k, deque()), False
        if kind == "open":
            queue.append(n)
            opened[k] = opened.get(k, 0) + 1
        elif kind == "close" and queue:
            queue.popleft()
            closed[k] = closed.get(k, 0) + 1
        elif kind == "close":
            orphan = True
        assert seen[(k, n)] == (opened.get(k, 0), closed.get(k, 0), len(queue), orphan)


@pytest.mark.parametrize("size", [1, 16, 10_000])
def test_last_before(spark, size):
    rng = random.Random(size)
    rows = [(k, i, rng.choice([None, "a", "b"])) for i, k in enumerate(hot_keys(rng, 400))]
    found = blocks.last_before(spark.createDataFrame(rows, "k string, n bigint, v string"), ["k"], "n",
                               {"last": (F.col("v").isNotNull(), F.col("v"))}, size).collect()
    seen, latest = {(r.k, r.n): r["last"] for r in found}, {}
    for k, n, v in rows:
        assert seen[(k, n)] == latest.get(k)
        latest[k] = v or latest.get(k)


@pytest.mark.parametrize("block_us", [3, 50, 10_000])
def test_window_hits(spark, block_us):
    rng, window = random.Random(block_us), 40
    rows, at = [], {}
    for i, k in enumerate(hot_keys(rng, 500)):
        at[k] = at.get(k, 0) + rng.choice([0, 0, 1, 5, 40, 41])
        rows.append((k, "t", i, at[k], rng.choice(["", "a", "b", "c"])))
    found = enrich.window_hits(spark.createDataFrame(
        rows, "n_plus_1_scope string, normalized_query string, sequence bigint, started_us bigint, signature string"), window, block_us).collect()
    seen = {r.sequence: (r.n_plus_1_hits, r.n_plus_1_distinct_args) for r in found}
    for k, _, i, t, _ in rows:
        inside = [s for k2, _, j, t2, s in rows if k2 == k and j <= i and t2 >= t - window]
        assert seen[i] == (len(inside), len({s for s in inside if s}))


@pytest.mark.parametrize("fan, levels", [(2, 0), (2, 1), (3, 3), (64, 3)])
def test_cooldown_chain(spark, fan, levels):
    rng, cool = random.Random(fan * 10 + levels), 20
    rows = [(k, rng.randint(0, 4000), i) for i, k in enumerate(hot_keys(rng, 900))]
    found = cooldown.fired(spark.createDataFrame(rows, "k string, t bigint, n bigint"), ["k"], "t", "n", cool, fan, levels)
    wanted, last = set(), {}
    for k, t, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= cool:
            last[k] = t
            wanted.add((k, t, n))
    assert {(r.k, r.at, r.seq) for r in found.collect()} == wanted


def test_lower_percentile(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0.0, rng.random() * 3, 17.25])) for k in hot_keys(rng, 700)]
    found = {r.k: r.p for r in analytics.lower_percentile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 0.95, "p").collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        assert found[key] == values[int((len(values) - 1) * 0.95)]


def test_active_connections_never_negative(spark):
    rng, now, wanted = random.Random(6), 0, {}
    rows = [(i, rng.choice(["open", "close", "close"])) for i in range(300)]
    for i, action in rows:
        now = now + 1 if action == "open" else max(0, now - 1)
        wanted[i] = now
    found = analytics.active_connections(spark.createDataFrame(rows, "order bigint, action string"), 16).collect()
    assert {r.order: r.active_connections for r in found} == wanted


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_queue_cap_stops_capture(spark, cap):
    rng = random.Random(cap)
    kinds = [(k, i, rng.choice(["Request", "Request", "Complete"])) for i, k in enumerate(hot_keys(rng, 300))]
    frame = spark.createDataFrame(kinds, "connection_id string, frame_no bigint, kind string").withColumns({
        "captured_us": F.col("frame_no"), "query": F.lit("q"), "args": F.array().cast("array<string>"), "extended": F.lit(False),
        "tag": F.lit(""), "error": F.lit("")})
    scanned = assemble.queue_scan(frame.where("kind = 'Request'").drop("kind", "tag", "error"),
                                  frame.where("kind <> 'Request'").drop("query", "args", "extended"), 32, cap)
    found = {(r.connection_id, r.frame_no): r.completed_frame for r in assemble.pair_requests(scanned).collect()}
    queues, stopped, wanted = {}, set(), {}
    for k, n, kind in kinds:
        queue = queues.setdefault(k, deque())
        if kind == "Request" and k not in stopped:
            if len(queue) >= cap:
                stopped.add(k)
                continue
            queue.append(n)
            wanted[(k, n)] = None
        elif kind == "Complete" and queue:
            wanted[(k, queue.popleft())] = n
    assert found == wanted


def test_preview_limits(spark):
    rows = [("a", i, ["x" * 4], 4) for i in range(10)] + [("b", 0, ["y" * 50], 50), ("b", 1, ["z"], 1), ("c", 0, ["é" * 3], 6)]
    found = {r.k: r for r in assemble.preview(
        spark.createDataFrame(rows, "k string, n bigint, cells array<string>, cell_bytes bigint"), ["k"], "n",
        Options(max_preview_rows=3, max_preview_bytes=9)).collect()}
    assert (len(found["a"].response_rows), found["a"].response_truncated, found["a"].response_total_rows) == (2, True, 10)
    # The first row is too large; nothing after it is shown.
    assert (found["b"].response_rows, found["b"].response_truncated, found["b"].response_total_bytes) == ([], True, 51)
    assert (found["c"].response_rows, found["c"].response_truncated) == ([["ééé"]], False)


def test_concurrency(spark):
    rows = [("a", 0, 10.0), ("a", 5_000, 1.0), ("a", 6_000, 9.0), ("b", 0, 0.0)]
    for block_us in (1_000, 10_000_000):
        found = timeline.concurrency(spark.createDataFrame(rows, "connection_id string, started_us bigint, duration_ms double"), block_us=block_us)
        assert {r.connection_id: r.peak for r in found.collect()} == {"a": 3, "b": 1}


def test_fitting_width(spark):
    rows = spark.createDataFrame([("hot", t) for t in range(1000)] + [("one", 5)] * 40, "k string, t bigint")
    width = blocks.fitting_width(rows, ["k"], "t", 10_000, 50)
    assert 1 <= width <= 50
    assert blocks.fitting_width(rows, ["k"], "t", 64, 100) == 64
    # Equal values stay together at any width.
    assert blocks.fitting_width(rows, ["k"], "t", 64, 10) == 1


def test_hot_key_plans_limit_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    plan = blocks.first_rows(rows, ["k"], ["n"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("rows", [1, 4, 250])
def test_active_connections_by_a_tree(spark, rows):
    """Blocks of 4 rows, 3 of them under a parent: four levels and more for 250 rows; no window is without keys."""
    rng = random.Random(rows)
    log = [(i * 2 + 7, rng.choice(["open", "close", "close", "other"]) if i % 50 < 30 else "open") for i in range(rows)]
    depth, wanted = 0, []
    for order, action in log:
        depth = depth + 1 if action == "open" else max(0, depth - 1) if action == "close" else depth
        wanted.append((order, action, depth))
    found = analytics.active_connections(spark.createDataFrame(log, "order bigint, action string"), block_rows=4, fan=3)
    assert sorted(tuple(r) for r in found.collect()) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
