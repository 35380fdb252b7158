"""The Merkle manifest against plain hashing, and against its SQL."""

import hashlib
import zlib

import duckdb

from wirelens.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Root of nodes, and the siblings of each, as (place, others) from below."""
    paths = [[] for _ in nodes]
    held = [(n, [i]) for i, n in enumerate(nodes)]
    while len(held) > 1:
        above = []
        for start in range(0, len(held), 16):
            run = held[start:start + 16]
            for at, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append((at, [n for k, (n, _) in enumerate(run) if k != at]))
            above.append((h(*(n for n, _ in run)), [i for _, below in run for i in below]))
        held = above
    return held[0][0], paths


def manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: climb([leaf(r) for r in trees[s]]) for s in names}
    root, above = climb([grown[s][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for row, path in zip(trees[s], grown[s][1]):
            path = path + above[at]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[4]
            if tampered and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf((*row[:4], text))
            for place, others in path:
                node = h(*others[:place], node, *others[place:])
            out.append((row[0], leaf(row), grown[s][0], root, h(*(x for _, others in path for x in others)), tampered, node, node == root))
    return sorted(out, key=repr)


def check(spark, documents, rows):
    frame = documents(rows)
    full = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in frame.collect()]
    wanted = manifest(full)
    assert sorted((tuple(r) for r in merkle.manifest(frame).collect()), key=repr) == wanted
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    duck.executemany("insert into documents values (?, ?, ?, ?, ?)", full)
    assert sorted(duck.execute(merkle.answer()).fetchall(), key=repr) == wanted
    return wanted


def test_awkward_rows(spark, documents, awkward):
    check(spark, documents, awkward)
    check(spark, documents, [(1, "Alone", None)])
    assert merkle.manifest(documents([])).count() == 0


def test_many_levels_and_sources(spark, documents):
    rows = [(i, f"Text {i} É", "hot") for i in range(4_400)]
    rows += [(10_000 + i, f"text {i}", f"s{i % 300:03d}") for i in range(900)]
    rows += [(20_000, "copy", "hot")] * 300 + [(None, "no id", None)] * 17
    found = check(spark, documents, rows)
    assert {r[7] for r in found if r[5]} == {False, True} and all(r[7] for r in found if not r[5])


def test_columns_may_be_null(spark):
    frame = spark.createDataFrame([(1, None, None, None, None), (2, "a", "", 0, "")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert sorted((tuple(r) for r in merkle.manifest(frame).collect()), key=repr) == manifest([tuple(r) for r in frame.collect()])
