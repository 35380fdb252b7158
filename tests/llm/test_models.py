"""Quality rules and the language model against plain counting."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wirelens.llm import arrays, language_model, quality


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    words, seen, doubled = word_list(text), set(), 0
    for line in (text or "").split("\n"):
        if word_list(line):
            doubled += line in seen
            seen.add(line)
    threes = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = [False] * len(words)
    for i in range(len(words) - 2):
        if threes[tuple(words[i:i + 3])] > 1:
            repeated[i:i + 3] = [True] * 3
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), doubled, sum(repeated)


def test_base_statistics(spark, documents, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 1, 0), (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    found = quality.score_documents(documents(awkward), labels).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=repr)
    wanted = [(r[0], *(b := base(r[1])), b[0] < 50 or 100 * b[4] > 50 * b[0]) for r in awkward]
    assert got == sorted(wanted, key=repr)
    assert not any(r.kept and r.base_failed for r in found)


def test_ratio_separates(spark, documents):
    rng = random.Random(4)
    good = [(i, " ".join(f"word{rng.randrange(40)}" for _ in range(120))) for i in range(30)]
    junk = [(100 + i, " ".join(f"j{rng.randrange(40)}***" for _ in range(120))) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id bigint, quality int, toxic int")
    docs = documents(good + junk)
    kept = {r.doc_id for r in quality.keep_documents(docs, labels, buckets=512).collect()}
    assert kept == {i for i, _ in good}
    assert quality.keep_documents(docs, labels, buckets=512).columns == docs.columns
    assert all(r.score == 0 for r in quality.score_documents(docs, labels.limit(0)).collect())
    assert quality.score_documents(documents([]), labels).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, documents, awkward, small_units, order):
    rows = [*awkward, *((30 + i, "The cat sat. the CAT ran " * (i % 3 + 70 * (i == 17)) + f"x{i}") for i in range(30))]
    held = {r[0]: zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in rows}
    lines = [(r[0], [*(r[1] or "").encode().lower().split(), 0]) for r in rows]
    counts = [Counter() for _ in range(order)]
    for doc, line in lines:
        if not held[doc]:
            for n in range(order):
                counts[n].update(tuple(line[i:i + n + 1]) for i in range(len(line) - n))
    total, types = sum(counts[0].values()), len(counts[0])
    once, twice = (sum(c == k for c in counts[0].values()) for k in (1, 2))
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))

    def chance(line, at):
        seen = counts[0][(line[at],)]
        p = (seen - discount) / total if seen else discount * types / total
        for n in range(1, min(order - 1, at) + 1):
            context = counts[n - 1][tuple(line[at - n:at])]
            if context:
                p = (counts[n][tuple(line[at - n:at + 1])] + 200.0 * p) / (context + 200.0)
        return math.log10(p)

    wanted = sorted(((d, held[d], len(x), sum((w,) in counts[0] for w in x), total,
                      round(sum(math.log10((counts[0][(w,)] + 1) / (total + types + 1)) for w in x), 5), round(sum(chance(x, i) for i in range(len(x))), 5)) for d, x in lines), key=repr)
    found = language_model.score_documents(documents(rows), order).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in found), key=repr)
    assert got == wanted


def test_automaton():
    """Numbered states, arcs, failure arcs and the carried state, by hand; pieces of any length give the same."""
    # Learned: a b a b c; read: a b d b c a b a (token numbers a b c d = 0 1 2 3).
    words, counts = [0, 1, 3, 1, 2, 0, 1, 0], {(0,): 2, (1,): 2, (2,): 1, (0, 1): 2, (1, 0): 1, (1, 2): 1, (0, 1, 0): 1, (0, 1, 2): 1, (1, 0, 1): 1}
    parts = []
    for n in (1, 2, 3):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        names = sorted(set(grams))
        parts.append((np.arange(len(grams)), np.array([names.index(g) for g in grams]), np.array([counts.get(g, 0) for g in names])))
    found = language_model.build(parts, 10.0, language_model.Totals(5, 3, 1, 2))
    # States: empty, a, b, c, ab, ba, bc.
    assert len(found.failure) == 1 + 3 + 3 and found.failure.tolist() == [0, 0, 0, 0, 2, 1, 3]
    assert len(found.arcs) == 3 + 3 + 1 and (np.diff(found.arcs) > 0).all()
    after, score = found.step(np.array([4, 4, 0]), np.array([0, 3, 3]))
    assert after.tolist() == [5, 0, 0] and score[1] == found.penalty[4] + found.penalty[2] + found.penalty[0]
    first = np.array([0, 6, 8])
    whole = found.traverse(np.array(words), first, 2, piece=100)
    for piece in (1, 2, 3, 5):
        assert (found.traverse(np.array(words), first, 2, piece=piece) == whole).all()
    assert len(found.traverse(np.zeros(0, int), np.array([0]), 2)) == 0


def test_quality_against_dictionaries(spark, documents, awkward):
    """Scores, toxicity and verdicts by plain dictionaries of whole n-grams and words; so many buckets that few are shared."""
    rng, size = random.Random(8), 1 << 19
    plain, bad = [f"w{i}" for i in range(30)], ["(Blight!", "blight", "grue;", "Wretch.", "moldy"]
    rows = [*awkward]
    for i in range(100, 190):
        words = rng.choices(plain, k=rng.randint(40, 90))
        if i % 3 == 0:
            for at in rng.sample(range(len(words)), 5):
                words[at] = rng.choice(bad)
        rows.append((i, " ".join(words)))
    marks = [(i, 0 if i % 7 == 0 else 1, 1 if i % 3 == 0 else 0) for i in range(100, 160)] + [(5, 1, 0), (101, 1, None), (102, None, 1), (None, 1, 1), (106, 0, 0), (106, 1, 0)]
    docs = documents(rows)
    found = quality.score_documents(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), buckets=size, toxic_buckets=size, threshold=-0.4, most_toxic=1.2).collect()
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    trusted = {i for i, q, t in marks if q == 1 and t != 1 and i is not None} - {i for i, q, t in marks if q == 0 or t == 1}

    def grams(text):
        words = (text or "").encode().lower().split()
        return [bucket[b" ".join(words[at : at + n])] for n in (1, 2) for at in range(len(words) - n + 1)]

    def bare(text):
        return {place[w] for w in plain_words(text)}

    def plain_words(text):
        return set(bytes(32 if 32 < b < 127 and not chr(b).isalnum() else b for b in (text or "").encode().lower()).split())

    split = [(t or "").encode().lower().split() for _, t, *_ in rows]
    names = sorted({b" ".join(w[at : at + n]) for w in split for n in (1, 2) for at in range(len(w) - n + 1)})
    hashed, owner = quality._features(*quality._lowered(pa.array([n.decode() for n in names])), size, 2)
    bucket = {names[o]: h for h, o in zip(hashed, owner)}  # the longest n-gram comes last
    bare_names = sorted(set().union(*(plain_words(t) for _, t, *_ in rows)))
    place = dict(zip(bare_names, quality._plain_words(pa.array([n.decode() for n in bare_names]), size)[0]))
    raw, target, clean, ugly = Counter(), Counter(), Counter(), Counter()
    for i, text, *_ in rows:
        raw.update(grams(text))
        target.update(grams(text) if i in trusted else [])
        clean.update(bare(text) if i in trusted else [])
        ugly.update(bare(text) if i in toxic else [])
    many = [sum(i in ids for i, *_ in rows) for ids in (toxic, trusted)]
    wanted = []
    for i, text, *_ in rows:
        one = [math.log((target[g] + 1) / (sum(target.values()) + size) * (sum(raw.values()) + size) / (raw[g] + 1)) for g in grams(text)]
        two = sorted((max(0.0, math.log((ugly[w] + 1) / (clean[w] * many[0] / many[1] + 1))) for w in bare(text)), reverse=True)
        wanted.append((i, (text or "")[:40], sum(one) / max(len(one), 1), sum(two[:3]) / 3))
    by_id = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words, r.score, r.toxicity, r.base_failed, r.kept) for r in found))
    plain_rows = sorted((-1 if i is None else i, len((t or "").encode().split()), s, x) for (i, _, s, x), (_, t, *_) in zip(wanted, rows))
    assert len(by_id) == len(plain_rows)
    for got, want in zip(by_id, plain_rows):
        assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-5 and abs(got[3] - want[3]) < 1e-5
        assert got[5] == (not got[4] and got[2] >= -0.4 and got[3] < 1.2)
    caught = {r.doc_id for r in found if r.toxicity >= 1.2}
    assert caught and all(i % 3 == 0 for i in caught) and any(i >= 160 for i in caught)


def test_nothing_to_learn(spark, documents):
    assert language_model.score_documents(documents([])).count() == 0
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = language_model.score_documents(documents([(doc, "a b")])).first()
    assert row.held_out and row.score == 0 and row.base_score == 0 and row.train_tokens == 0


def test_quality_working_memory():
    """Base counts need few bytes for each of the text, whatever a text's length, and the same counts come out; a piece of a batch is small."""
    rng = random.Random(6)
    texts = [" ".join(f"wörd{rng.randrange(5000)}" + "\n" * (i % 9 == 0) for i in range(40_000)) for _ in range(3)]
    texts += ["ab cd #\n" * 40_000, "", None]
    column = pa.array(texts)
    arrays._powers.clear()
    tracemalloc.start()
    found = quality.base_statistics(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * column.nbytes
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert list(zip(*(found[n].tolist() for n in names))) == [base(t) for t in texts]
    assert quality.PIECE <= 1 << 19


def test_blocks_of_counts():
    """Counts of several tasks, sent as blocks of buckets, have the sums of their buckets; sizes that blocks do not divide."""
    rng, sizes = np.random.default_rng(2), (512, 1001)
    tasks = [[rng.integers(0, 9, (2, size)) * (rng.random((2, size)) < share) for size in sizes] for share in (0.9, 0.01, 0.0)]
    sent = [batch for totals in tasks for batch in quality._blocks(totals)]
    found = quality._added(quality._blocks(quality._added(sent, sizes)), sizes)
    assert all((f == sum(t[k] for t in tasks)).all() for k, f in enumerate(found))
    assert all(not f.any() for f in quality._added([], sizes))
