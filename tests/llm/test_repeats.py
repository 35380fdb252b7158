"""Substring and byte dedup against a scan that remembers every window."""

import dataclasses
import hashlib
import random

import numpy as np
import pytest

from wirelens.llm import substrings, suffixes, units


def ordered(rows):
    return sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def brute(rows, length, items, join):
    seen, out = set(), []
    for doc, text in ordered(rows):
        own = items(text)
        gone = [False] * len(own)
        for at in range(len(own) - length + 1):
            window = own[at:at + length] if isinstance(own, bytes) else tuple(own[at:at + length])
            if window in seen:
                gone[at:at + length] = [True] * length
            seen.add(window)
        out.append((doc, len(own), sum(gone), hashlib.sha256(join(x for x, g in zip(own, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def fuzz(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(6)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(3)]
    return [(i, " ".join(rng.choice([rng.choice(passages), *vocabulary]) for _ in range(rng.randint(0, 25)))) for i in range(40)]


@pytest.mark.parametrize("window", [20, 5])
def test_words(spark, documents, awkward, small_units, window):
    for rows in (awkward, fuzz(window)):
        found = substrings.remove_repeats(documents(rows), window).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found), key=repr)
        assert got == brute(rows, window, lambda t: t.encode().split(), lambda kept: b" ".join(kept))
        assert all(r.n_removed == sum(s.stop - s.start for s in r.removed) for r in found)


@pytest.mark.parametrize("length, hot", [(100, 128), (40, 0)])
def test_bytes(spark, documents, awkward, small_units, monkeypatch, length, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = [*awkward, (20, "ab" * 300), (21, "ab" * 80), (22, "x" * 250)]
    for rows in (rows, fuzz(length)):
        found = suffixes.remove_repeated_bytes(documents(rows), length).collect()
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in found), key=repr)
        assert got == brute(rows, length, lambda t: t.encode(), bytes)
        assert all(r.n_spans == len(r.removed) for r in found)


def test_layout_of_distant_ids():
    """Ids far from the others get units of their own; the order of units is the order of ids."""
    plan = units.Layout((-5, 10, 1000), (8, 495, 3_000_000_000_000), 2, 7, 5)
    ids = np.array([-5, 2, 3, 9, 10, 504, 505, 999, 1000, 2_000_000, 6_000_000_000_000])
    assert plan.number(ids).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_distant_ids(spark, documents, small_units):
    rows = [(r[0] if r[0] < 38 else r[0] * 10**15, r[1]) for r in fuzz(9)] + [(-(10**17), "t1 t2 " * 30)]
    found = substrings.remove_repeats(documents(rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found), key=repr)
    assert got == brute(rows, 20, lambda t: t.encode().split(), lambda kept: b" ".join(kept))
    plan = units.layout(documents([(i, "x" * 100) for i in range(300)] + [(10**15, "x" * 100)]))
    assert np.bincount(np.unique(plan.number(np.arange(300)), return_inverse=True)[1]).max() <= 100


@pytest.mark.parametrize("bits", [15, 16, 18])
def test_many_buckets(spark, documents, small_units, monkeypatch, bits):
    """Layouts of large corpora: from 16 bits on a probe travels whole."""
    plan = units.layout
    monkeypatch.setattr(units, "layout", lambda frame, **kind: dataclasses.replace(plan(frame, **kind), bits=bits))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"{passage} own{i} " + " ".join(f"x{i}y{j}" for j in range(20))) for i in range(8)]
    found = substrings.remove_repeats(documents(rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found), key=repr)
    assert got == brute(rows, 20, lambda t: t.encode().split(), lambda kept: b" ".join(kept))


def test_empty(spark, documents):
    assert substrings.remove_repeats(documents([])).count() == 0
    assert suffixes.remove_repeated_bytes(documents([])).count() == 0
