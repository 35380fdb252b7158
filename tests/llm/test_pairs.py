"""Near-duplicates and decontamination against all pairs."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wirelens.llm import decontaminate, simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), seed=42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in root}


def near(seed, n=25):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 400, 200)) for _ in range(n)]
    changed = [t.replace("v7 ", "v8 ", 1) for t in texts]
    return [(i, t) for i, t in enumerate([*texts, *changed, *texts[:5]])]


def test_components(spark, documents, awkward):
    rows = [*[(r[0] if r[0] is None else r[0] + 500, *r[1:]) for r in awkward], *near(1)]
    prints = {r[1]: fingerprint(r[1]) for r in rows}
    root = classes(set(prints.values()))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[root[prints[r[1]]]] = min(r[0], least.get(root[prints[r[1]]], r[0]))
    wanted = sorted(((r[0], f"{prints[r[1]]:016x}", least.get(root[prints[r[1]]])) for r in rows), key=repr)
    docs = documents(rows)
    found = simhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in found), key=repr) == wanted
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(documents([])).count() == 0


def test_names_are_no_longer_than_nodes(spark, monkeypatch, capsys):
    """A component in all parts, and many small ones: each name is told to the parts that have nodes, and to no other."""
    rng = np.random.default_rng(6)
    base, *lone = (int(x) for x in rng.integers(0, 1 << 63, 91, dtype=np.int64))
    large = [base, *(base ^ 1 << b for b in range(63))]
    rows = [*((None if i == 2 else 500 - i, i, fp) for i, fp in enumerate(large)), *((1000 + i, i, fp) for i, fp in enumerate(lone)), (2000, 7, lone[0]), (None, 8, lone[1])]
    frame = spark.createDataFrame(rows, "doc_id long, row long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda documents, shingle: frame)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = simhash.near_duplicates(frame)
        told = found.collect()
        found.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    least = {fp: 437 if fp in set(large) else 1000 + lone.index(fp) for *_, fp in rows}
    assert sorted((tuple(r) for r in told), key=repr) == sorted(((i, f"{fp:016x}", least[fp]) for i, _, fp in rows), key=repr)
    sent = [float(x) for x in re.findall(r"rowCount=([0-9.E+]+)", capsys.readouterr().out)]
    assert sent and max(sent) <= len(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(4)]
    dense = np.uint64(77) ^ rng.integers(0, 32, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *flips, dense]))
    a, b = simhash.trie_links(values, np.zeros(len(values), np.int64), 4)
    assert all((int(values[i]) ^ int(values[j])).bit_count() <= 5 for i, j in zip(a, b))
    root = {int(v): int(v) for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, j in zip(values[a].tolist(), values[b].tolist()):
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert {v: find(v) for v in root} == classes(set(values.tolist()))


ITEMS = [
    (1, "Which of the seven rivers crosses the northern province twice before it reaches the shallow inland sea? The river Orlen crosses it twice."),
    (2, "Name the metal that ancient smiths of the island mixed with copper for their bells. They used tin from the western mines."),
    (3, ""), (4, None),
]


def test_leaks(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "RANK", 16)
    rng = np.random.default_rng(5)
    noise = lambda n: " ".join(f"filler{x}" for x in rng.integers(0, 500, n))
    whole = ITEMS[0][1]
    paraphrase = "Which of the seven great rivers crosses our northern province twice until it reaches the shallow inland sea? The river Orlen crosses it twice."
    half = " ".join(ITEMS[1][1].split()[:9])
    rows = [(1, f"{noise(300)} {whole} {noise(90)}"), (2, noise(400)), (3, f"{noise(40)} {paraphrase} {noise(40)}"), (4, f"{noise(40)} {half} {noise(40)}"),
            (5, whole.upper()), (6, None), (7, ""), (None, f"x {ITEMS[1][1]}"), (5, whole.upper())]
    docs, bench = documents(rows), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()), key=repr)
    every = sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, least=-1.0).collect()), key=repr)
    assert found == every == sorted([(1, 1), (3, 1), (5, 1), (5, 1), (None, 2)], key=repr)
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 4, 6, 7]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(documents([]), bench).count() == 0


def test_space_of_all_documents(spark, documents, monkeypatch):
    """More than half a million words: every document counts, and the space holds what the exact singular vectors do."""
    monkeypatch.setattr(decontaminate, "RANK", 12)
    monkeypatch.setattr(decontaminate, "FIT_WORDS", 1 << 14)
    rng = np.random.default_rng(3)
    topics = [[f"t{k}x{i}" for i in range(12)] for k in range(12)]
    texts = [" ".join(rng.choice(topics[i % 12], 1800)) for i in range(330)]
    docs = documents([*enumerate(texts), (None, None), (331, "")]).repartition(3).select("text")
    weight, _ = decontaminate.weights(docs)
    spread = decontaminate.spread(docs, weight)
    parts = []
    for text in texts:
        terms, starts = decontaminate._passages(*decontaminate._tokens(pa.array([text])))
        parts += [np.bincount(x, minlength=decontaminate.TERMS) for x in np.split(terms, starts[1:])]
    used = np.flatnonzero(weight * np.sum(parts, axis=0))
    passages = np.array([x[used] for x in parts]) * weight[used].astype(np.float64)
    wanted = passages.T @ (passages @ decontaminate._directions()[used].astype(np.float64))
    assert np.allclose(spread[used], wanted, rtol=1e-3, atol=1e-3 * np.abs(wanted).max())
    assert len(np.flatnonzero(spread.any(axis=1))) == len(used)
    space = decontaminate.latent_space(spread, (np.zeros(0, np.int64), np.zeros(1, np.int64)), weight)
    held = np.linalg.norm(passages @ space[used]) ** 2
    best = (np.linalg.svd(passages, compute_uv=False)[:12] ** 2).sum()
    assert space.shape[1] == 12 and held > 0.99 * best


def test_products_of_passages(monkeypatch):
    """Frequent terms as a table, the others one by one, whatever the length of passages; equal to the plain product."""
    monkeypatch.setattr(decontaminate, "RANK", 8)
    rng = np.random.default_rng(2)
    terms = rng.zipf(1.3, 40_000) * 7 % decontaminate.TERMS
    starts = np.unique(np.concatenate([[0], rng.integers(0, len(terms), 9_000), [len(terms) - 3_000]]))
    starts = starts[(starts < 20_000) | (starts > 21_000)]
    weight, right = rng.random(decontaminate.TERMS, np.float32), decontaminate._directions()
    rows, found = decontaminate._there_and_back(terms, starts, weight, right)
    assert sorted(rows) == sorted(set(terms.tolist()))
    owner = np.searchsorted(starts, np.arange(len(terms)), "right") - 1
    np.add.at(lines := np.zeros((len(starts), right.shape[1])), owner, weight[terms, None] * right[terms].astype(np.float64))
    np.add.at(wanted := np.zeros(right.shape), terms, weight[terms, None] * lines[owner])
    assert np.allclose(found, wanted[rows], rtol=1e-3, atol=1e-4 * np.abs(wanted).max())


def test_windows_without_the_words_of_an_item(monkeypatch):
    """Only windows that have enough of an item's words are compared word by word, and none of those is left out."""
    monkeypatch.setattr(decontaminate, "RANK", 8)
    monkeypatch.setattr(decontaminate, "WINDOW_WORDS", 500)
    rng = np.random.default_rng(4)
    noise = lambda n: " ".join(f"filler{x}" for x in rng.integers(0, 300, n))
    texts = [noise(2_000), f"{noise(100)} {ITEMS[0][1]} {noise(700)} {ITEMS[1][1]}", "", ITEMS[1][1], f"{noise(50)} {ITEMS[0][1]}"]
    weight = np.ones(decontaminate.TERMS, np.float32)
    items = decontaminate._prepared([{"item_id": i, "text": x} for i, x in ITEMS], weight, np.zeros((decontaminate.TERMS, 16), np.float32))
    words, first = decontaminate._tokens(pa.array(texts))
    compared, verdict = [], decontaminate._verdict
    monkeypatch.setattr(decontaminate, "_verdict", lambda *given: compared.append(given[2]) or verdict(*given))
    found = decontaminate.leaks(words, first, items, -1.0, 0.8, 0.6)
    wanted: dict = {}
    for doc, i, block in zip(*(x.tolist() for x in decontaminate._candidates(words, first, items, -1.0)), strict=True):
        low = first[doc] + max(0, block - 1) * decontaminate.BLOCK
        got = verdict(words[low:min(first[doc + 1], first[doc] + (block + items.blocks[i] + 1) * decontaminate.BLOCK)].tolist(), items, i, 0.8, 0.6)
        if got:
            wanted[doc, i] = max(got, wanted.get((doc, i), (0, False)))
    assert found == wanted and len(found) >= 4
    assert len(compared) < 40
