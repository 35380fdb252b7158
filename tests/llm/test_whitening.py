"""Whitening against a full eigendecomposition."""

import math

import numpy as np
import pytest

from wirelens.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    return frame.selectExpr("*", "1 as x", "'a' as cell", "2 as value", "3 as n", "4 as component", "5 as `a b`")


def brute(rows, components):
    """vec_id -> rows of (component, n, deviation, whitened, explained), signs as they come."""
    kept = [(i, [np.float32(c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    exact = [(i, tuple([math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v)))) for i, v in kept]
    fit = sorted({x for _, x in exact})
    n = len(fit)
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    numerators = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(numerators.T @ numerators / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in exact:
        moved = [n * a - s for a, s in zip(x, sums)]
        for c in range(min(components, dims)):
            if values[c] > 1e-12 * values[0]:
                out.append((i, c + 1, n, sum(m * m for m in moved), float(np.array(moved, float) / n @ vectors[:, c] / np.sqrt(values[c])), values[c] / values.sum()))
    return out


def compare(found, wanted):
    assert len(found) == len(wanted)
    key = lambda r: (repr(r[0]), r[3], r[1], abs(r[4]))
    found, wanted = sorted((tuple(r) for r in found), key=key), sorted(wanted, key=key)
    signs = {}
    for got, want in zip(found, wanted):
        assert got[:4] == want[:4]
        assert got[5] == pytest.approx(want[5], rel=1e-9) and got[6] < 1e-9
        assert abs(got[4]) == pytest.approx(abs(want[4]), rel=1e-7, abs=1e-7)
        if abs(want[4]) > 1e-3:
            signs.setdefault(got[1], set()).add(math.copysign(1, got[4] * want[4]))
    assert all(len(s) == 1 for s in signs.values())


def test_filter_finds_the_leading_part(spark):
    rng = np.random.default_rng(3)
    spread = np.concatenate([[5.0, 3.0], np.linspace(1.1, 0.9, 58)])
    vectors = (rng.standard_normal((700, 60)) * spread) @ np.linalg.qr(rng.standard_normal((60, 60)))[0] + 0.3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += rows[:40] * 3
    found = whitening.whiten(table(spark, rows).repartition(5), components=4, guard=6).collect()
    compare(found, brute(rows, 4))
    fit = whitening.quantize(table(spark, rows)).select("x").distinct()
    mean = whitening.centre(fit, 60)
    held = whitening.spectrum(fit, mean, 4, guard=6)
    assert held.residual <= whitening.FLOOR and held.passes > whitening.DEGREE


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(5)]) for i in range(30)]
    rows += [(None, [0.5, 1.0, -2.0, 0.0, 3.0]), (None, None), (40, None), (41, [1.0, None, 2.0, 0.0, 0.0]), (42, [math.nan] * 5), (43, [1.0, math.inf, 0.0, 0.0, 0.0]),
             (44, [1.0, 2.0]), (45, []), (3, rows[3][1]), (3, rows[3][1]), (46, [1.0, 2.0, 0.0, 0.0, 0.0])]
    compare(whitening.whiten(table(spark, rows)).collect(), brute(rows, 16))


def test_few_dimensions_have_variance(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(20)]
    found = whitening.whiten(table(spark, rows)).collect()
    assert {r.component for r in found} == {1}
    compare(found, brute(rows, 16))


def test_nothing_to_whiten(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3.0e7, 2.0]), (4, [0.0, 0.25])]
    found = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    x = [[2**46, 0], [-(2**46), 64], [int(np.float32(3.0e7)) * 64, 128], [0, 16]]
    sums = [sum(v[d] for v in x) for d in range(2)]
    for i, v in enumerate(x):
        exact = sum((4 * a - s) ** 2 for a, s in zip(v, sums))
        assert found[i + 1] == (exact if exact < 2**63 else None)
