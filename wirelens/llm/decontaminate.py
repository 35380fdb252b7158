"""Benchmark decontamination: latent semantic candidates, then longest common subsequence and answer checks."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import number_rows
from ..operators.materialize import materialize
from . import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERMS = 1 << 15
BLOCK = 16  # words of a block; windows are whole blocks
FIT_PASSAGE = 64
FIT_WORDS = 1 << 21  # words whose passages are multiplied at a time
FIT_TASKS = 64
SEED = 7
ITEMS = 256  # benchmark items searched in one pass
RANK = 256
ITEM_WEIGHT = 30.0
# How strongly rare words outweigh frequent ones.
STEEP = 1.5
PIECE = 256 << 10
# Blocks whose terms are looked up at a time, and rows added up at a time: what they need stays in the processor's cache.
STRIDE = 64
GATHER = 256
DENSE = 256  # the most frequent terms of the passages at hand, multiplied as a table
PASSAGES = 4096  # passages of such a table
WINDOW_WORDS = 1 << 18  # words of candidates looked at together
ROWS = 1024
_LOWER = arrays.LOWER.tobytes()
MATCH = "doc_id long, item_id long, item_words int, common_words int, has_answer boolean"


@dataclass
class Items:
    """A block of benchmark items by size, made for comparing: per word the places it has, the answer, and how many blocks hold the item."""

    ids: list[int | None]
    places: list[dict[int, int]]
    lengths: np.ndarray
    answers: list[tuple[int, ...]]
    blocks: np.ndarray
    likeness: np.ndarray  # of every term to every item, in the latent space
    squares: np.ndarray  # of every term's weight
    counts: np.ndarray  # words of every item, by term


def _tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.text_bytes(column)
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    starts, ends, first = arrays.word_spans(data, offsets)
    return arrays.word_hashes(data, starts, ends), first


def _terms(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(TERMS)).astype(np.int64)


def answer_of(text: str) -> str:
    """The last sentence of an item: what follows the last end of a sentence or line before it."""
    parts = [x for x in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if x.strip()]
    return parts[-1] if len(parts) > 1 else ""


def weights(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Weight of every term by the number of documents that have it, and the number of words; over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, total = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                words, first = _tokens(piece.column(0))
                doc = np.repeat(np.arange(piece.num_rows), np.diff(first))
                found += np.bincount(_distinct(doc * TERMS + _terms(words)) % TERMS, minlength=TERMS)
                rows, total = rows + piece.num_rows, total + len(words)
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*full.tolist(), -1, -2]), pa.array([*found[full].tolist(), rows, total])], ["term", "n"])

    counts = np.zeros(TERMS + 2)
    # One row a term at most.
    for row in documents.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["term"]] = row["n"]
    return (np.log((counts[-1] + 1) / (counts[:TERMS] + 1)) ** STEEP).astype(np.float32), int(counts[-2])


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _passages(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts, and where each passage of FIT_PASSAGE words begins."""
    place = arrays.place(first, len(words))
    return _terms(words), np.flatnonzero(place % FIT_PASSAGE == 0)


def _there_and_back(terms: np.ndarray, starts: np.ndarray, weight: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of weighted passages, transposed, times itself, times a matrix of terms by dimensions: the terms that occur, and their rows.

    The most frequent terms are a dense table of counts; only the words of the others are looked up one by one.
    """
    edges = np.append(starts, len(terms))
    found = np.bincount(terms, minlength=TERMS)
    top = np.argsort(found, kind="stable")[-DENSE:]
    top = top[found[top] > 0]
    column = np.full(TERMS, -1, np.int32)
    column[top] = np.arange(len(top))
    # One row for each term that occurs, the frequent ones first.
    rows = np.concatenate([top, np.flatnonzero((found > 0) & (column < 0))])
    out = np.zeros((len(rows), right.shape[1]), np.float32)
    dense, others = out[:len(top)], out[len(top):]
    weighted = weight[top, None] * right[top]
    left, held = np.empty((len(starts), right.shape[1]), np.float32), np.empty((GATHER, right.shape[1]), np.float32)
    rare, rare_owner = [], []
    for at in range(0, len(starts), PASSAGES):
        upto = min(at + PASSAGES, len(starts))
        own = terms[edges[at]:edges[upto]]
        owner = np.repeat(np.arange(upto - at, dtype=np.int32), np.diff(edges[at:upto + 1]))
        place = column[own]
        often = place >= 0
        table = np.bincount(owner[often] * np.int32(len(top)) + place[often], minlength=(upto - at) * len(top))
        table = table.reshape(-1, len(top)).astype(np.float32)
        np.matmul(table, weighted, out=left[at:upto])
        own, owner = own[~often], owner[~often]
        own_weight, sizes = weight[own], np.bincount(owner, minlength=upto - at)
        first = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        if sizes.max() > len(held):
            held = np.empty((int(sizes.max()), right.shape[1]), np.float32)
        for i, a, b in zip(range(at, upto), first, first[1:], strict=False):
            left[i] += own_weight[a:b] @ right.take(own[a:b], axis=0, out=held[:b - a], mode="clip")
        dense += table.T @ left[at:upto]
        rare.append(own.astype(np.uint16))
        rare_owner.append(owner + np.int32(at))
    if len(others):
        order = np.argsort(np.concatenate(rare), kind="stable")
        rare_owner = np.concatenate(rare_owner)[order].astype(np.int64)
        upto = np.cumsum(found[rows[len(top):]]).tolist()
        ones = np.ones(GATHER, np.float32)
        for row, a, b in zip(others, [0, *upto], upto, strict=False):
            for at in range(a, b, GATHER):
                n = min(GATHER, b - at)
                row += ones[:n] @ left.take(rare_owner[at:at + n], axis=0, out=held[:n], mode="clip")
    out *= weight[rows, None]
    return rows, out


def _turned(base: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """base @ turn, some rows at a time; in double precision, but never a whole matrix of it."""
    out = np.empty((len(base), turn.shape[1]), np.float32)
    for at in range(0, len(base), ROWS):
        out[at:at + ROWS] = base[at:at + ROWS].astype(np.float64) @ turn
    return out


def _orthonormal(base: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of base, by its Gram matrix, twice; columns beyond its rank are zero."""
    for _ in range(2):
        gram = np.zeros((base.shape[1], base.shape[1]))
        for at in range(0, len(base), ROWS):
            part = base[at:at + ROWS].astype(np.float64)
            gram += part.T @ part
        values, turn = np.linalg.eigh(gram)
        full = values > 1e-12 * values[-1]
        base = _turned(base, turn * np.where(full, 1 / np.sqrt(np.where(full, values, 1.0)), 0.0))
    return base


def _gram(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left.T @ right in double precision, some rows at a time."""
    out = np.zeros((left.shape[1], right.shape[1]))
    for at in range(0, len(left), ROWS):
        out += left[at:at + ROWS].astype(np.float64).T @ right[at:at + ROWS]
    return out


def _directions() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TERMS, RANK + 8), dtype=np.float32)


def spread(texts: DataFrame, weight: np.ndarray) -> np.ndarray:
    """What all passages of all texts make of the random directions: the matrix of weighted passages, transposed, times itself, times them.

    One pass over the texts. Tasks multiply their passages, some FIT_WORDS words at a
    time; only matrices of terms by directions meet, in slices of terms, one from
    each task. So there are as many tasks as cores, and FIT_TASKS at most.
    """
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, right = shared.value, _directions()
        out = np.zeros_like(right)

        def take(held: list[tuple[np.ndarray, np.ndarray]]) -> None:
            before = np.cumsum([0, *(len(terms) for terms, _ in held)])
            terms, starts = np.concatenate([x for x, _ in held]), np.concatenate([x + n for (_, x), n in zip(held, before[:-1], strict=True)])
            rows, found = _there_and_back(terms, starts, weight, right)
            for at in range(0, len(rows), ROWS):
                out[rows[at:at + ROWS]] += found[at:at + ROWS]

        held, words = [], 0
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                held.append(_passages(*_tokens(piece.column(0))))
                # Short texts have passages of less than FIT_PASSAGE words.
                words += max(len(held[-1][0]), FIT_PASSAGE * len(held[-1][1]))
                if words >= FIT_WORDS:
                    take(held)
                    held, words = [], 0
        if held:
            take(held)
        for at in range(0, len(out), ROWS):
            if out[at:at + ROWS].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out[at:at + ROWS].tobytes()], pa.binary())], ["at", "rows"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.float32) for x in table.column("rows")], axis=0, dtype=np.float32)
        return pa.table({"at": table.column("at").slice(0, 1).cast(pa.int64()), "rows": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((TERMS, RANK + 8), np.float32)
    tasks = max(1, min(context.defaultParallelism, FIT_TASKS))
    # Terms by directions at most.
    for row in texts.select("text").coalesce(tasks).mapInArrow(run, "at long, rows binary").groupBy("at").applyInArrow(add, "at long, rows binary").toLocalIterator():
        part = np.frombuffer(row["rows"], np.float32).reshape(-1, out.shape[1])
        out[row["at"]:row["at"] + len(part)] = part
    shared.destroy()
    return out


def latent_space(spread_out: np.ndarray, items: tuple[np.ndarray, np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Orthonormal directions (terms by rank) in which the passages vary most: randomised singular vectors.

    ``spread_out`` is what the passages of all documents make of the random directions
    (``spread``); those of the items are added. The result spans the space, and with
    the directions themselves it also tells how much the passages vary along each
    (Nystrom), so the documents need not be read again.
    """
    own_terms, own_first = items
    own_starts = own_first[:-1][np.diff(own_first) > 0]
    random = _directions()
    rows, found = _there_and_back(own_terms, own_starts, weight, random)
    sampled = spread_out.copy()
    sampled[rows] += found * np.float32(ITEM_WEIGHT * ITEM_WEIGHT)
    inner = _gram(random, sampled)
    del random
    base = _orthonormal(sampled)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    full = values > 1e-6 * values[-1]
    half = _gram(base, sampled) @ (turn * np.where(full, 1 / np.sqrt(np.where(full, values, 1.0)), 0.0))
    values, turn = np.linalg.eigh(half @ half.T)
    return _turned(base, turn[:, ::-1][:, :RANK])


def _prepared(rows: list, weight: np.ndarray, spread_out: np.ndarray) -> Items:
    rows = [x for x in rows if (x["text"] or "").encode().split()]
    rows.sort(key=lambda x: len(x["text"].encode().split()))
    words, first = _tokens(pa.array([x["text"] for x in rows], pa.string()))
    answers, answer_first = _tokens(pa.array([answer_of(x["text"]) for x in rows], pa.string()))
    space = latent_space(spread_out, (_terms(words), first), weight)
    by_term = space
    by_term *= weight[:, None]
    places, vectors = [], np.zeros((len(rows), RANK), np.float32)
    for i in range(len(rows)):
        own = words[first[i]:first[i + 1]]
        found: dict[int, int] = {}
        for at, word in enumerate(own.tolist()):
            found[word] = found.get(word, 0) | 1 << at
        places.append(found)
        vectors[i] = by_term[_terms(own)].sum(axis=0)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    lengths = np.diff(first)
    likeness = np.zeros((TERMS + 1, len(rows)), np.float32)
    np.matmul(by_term, vectors.T, out=likeness[:TERMS])
    counts = np.zeros((TERMS, len(rows)), np.int32 if len(words) >> 15 else np.int16)
    np.add.at(counts, (_terms(words), np.repeat(np.arange(len(rows)), lengths)), 1)
    return Items(
        [x["item_id"] for x in rows], places, lengths, [tuple(answers[a:b].tolist()) for a, b in zip(answer_first[:-1], answer_first[1:], strict=True)],
        (lengths + 2 * BLOCK - 2) // BLOCK, likeness, np.append(weight * weight, 0).astype(np.float32), counts)


def common_words(window: list[int], places: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence of a window and an item, a bit for each word of the item."""
    everything = (1 << length) - 1
    row = everything
    for word in window:
        both = row & places.get(word, 0)
        if both:
            row = (row + both | row - both) & everything
    return length - row.bit_count()


def _verdict(words: list[int], items: Items, i: int, sure: float, likely: float) -> tuple[int, bool] | None:
    """Common words of a window and an item and whether it has the answer, if it counts as a leak."""
    length, places = int(items.lengths[i]), items.places[i]
    seen = 0
    for word in words:
        seen |= places.get(word, 0)
    if seen.bit_count() < likely * length:
        return None
    common = common_words(words, places, length)
    if common < likely * length:
        return None
    answer = items.answers[i]
    has = bool(answer) and any(tuple(words[at:at + len(answer)]) == answer for at, word in enumerate(words) if word == answer[0])
    return (common, has) if common >= sure * length or has else None


def _candidates(words: np.ndarray, first: np.ndarray, items: Items, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, items and first blocks of windows whose cosine to the item is ``least`` or more; least below 0: all windows.

    Every text begins a block of its own; its last one is filled up with a term that
    is like nothing, and no window passes from one text to the next.
    """
    sizes = np.diff(first)
    edges = np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
    table = np.full((int(edges[-1]), BLOCK), TERMS, np.int64)
    table.reshape(-1)[np.repeat(edges[:-1] * BLOCK - first[:-1], sizes) + np.arange(len(words))] = _terms(words)
    sums = np.zeros((len(table), len(items.ids)), np.float32)
    held = np.empty((STRIDE, len(items.ids)), np.float32)
    for at in range(0, len(table), STRIDE):
        part, own = table[at:at + STRIDE], sums[at:at + STRIDE]
        for i in range(BLOCK):
            own += items.likeness.take(part[:, i], axis=0, out=held[:len(own)], mode="clip")
    squares = np.concatenate([[0], np.cumsum(items.squares[table].sum(axis=1, dtype=np.float64))])
    doc = np.repeat(np.arange(len(sizes)), np.diff(edges))
    block, begin, end = np.arange(len(table)), edges[:-1][doc], edges[1:][doc]
    found = []
    # Items stand in the order of their size, so those of one size are neighbouring columns.
    opens = np.flatnonzero(np.diff(items.blocks, prepend=-1))
    for low_item, high_item in zip(opens, [*opens[1:], len(items.blocks)], strict=True):
        size = int(items.blocks[low_item])
        low = np.flatnonzero((block + size <= end) | (block == begin))
        high = np.minimum(low + size, end[low])
        upto = np.zeros((high_item - low_item, len(table) + 1))
        np.cumsum(np.array(sums[:, low_item:high_item].T, np.float64, order="C"), axis=1, out=upto[:, 1:])
        dots = upto.take(high, axis=1)
        dots -= upto.take(low, axis=1)
        norm = np.sqrt(np.maximum(squares[high] - squares[low], 1e-9))
        item, at = np.divmod(np.flatnonzero(dots >= least * norm) if least >= 0 else np.arange(dots.size), len(low))
        found.append((doc[low[at]], item + low_item, low[at] - begin[low[at]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _enough(terms: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, items: Items, likely: float) -> np.ndarray:
    """Which windows have terms of ``likely`` of the item's words at least; each term of a window counts once."""
    order = np.argsort(terms.astype(np.uint16), kind="stable")
    same = terms[order][1:] == terms[order][:-1]
    before = np.full(len(terms), -1)
    before[order[1:][same]] = order[:-1][same]
    keep = np.zeros(len(low), bool)
    upto = np.concatenate([[0], np.cumsum(high - low)])
    start = 0
    while start < len(low):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + WINDOW_WORDS, "right")) - 1)
        sizes = (high - low)[start:end]
        own = np.repeat(np.arange(start, end), sizes)
        word = np.arange(upto[start], upto[end]) - np.repeat(upto[start:end] - low[start:end], sizes)
        new = before[word] < low[own]
        own, word = own[new], word[new]
        seen = np.bincount(own - start, items.counts[terms[word], item[own]], end - start)
        keep[start:end] = seen >= likely * items.lengths[item[start:end]]
        start = end
    return keep


def leaks(words: np.ndarray, first: np.ndarray, items: Items, least: float, sure: float, likely: float) -> dict[tuple[int, int], tuple[int, bool]]:
    """Items that texts hold: (text, item) -> best (common words, answer found)."""
    found: dict[tuple[int, int], tuple[int, bool]] = {}
    doc, item, block = _candidates(words, first, items, least)
    # A candidate with a block on either side.
    low = first[doc] + np.maximum(0, block - 1) * BLOCK
    high = np.minimum(first[doc + 1], first[doc] + (block + items.blocks[item] + 1) * BLOCK)
    keep = _enough(_terms(words), low, high, item, items, likely)
    for d, i, start, stop in zip(*(x[keep].tolist() for x in (doc, item, low, high)), strict=True):
        got = _verdict(words[start:stop].tolist(), items, i, sure, likely)
        if got and got > found.get((d, i), (0, False)):
            found[d, i] = got
    return found


def _blocks_of_items(documents: DataFrame, benchmark: DataFrame, fit_words: int) -> Iterator[Broadcast]:
    """The benchmark ready for search, some items at a time."""
    context = documents.sparkSession.sparkContext
    held = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = materialize(number_rows(held, [F.col("item_id").asc_nulls_last(), "text"], "place"))
    n = numbered.count()
    if not n:
        return
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weight, total = weights(texts)
    spread_out = spread(texts, weight) * np.float32(min(1.0, fit_words / max(total, 1)))
    for low in range(0, n, ITEMS):
        rows = numbered.where((F.col("place") > low) & (F.col("place") <= low + ITEMS)).orderBy("place").collect()
        # Arrays and lists alone are broadcast: workers need not know this module to read them.
        items = _prepared(rows, weight, spread_out)
        yield context.broadcast(tuple(getattr(items, f.name) for f in fields(Items)))


def find_leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.18, sure: float = 0.8, likely: float = 0.6, fit_words: int = 500_000) -> DataFrame:
    """Benchmark items that documents hold: one row for each document and item.

    1. Words are hashed to terms, weighted by the inverse of the number of all
       documents that have them. Passages of 64 words of all documents and the items
       give a latent space by a randomised singular value decomposition. Items count
       more: however many words the documents have, together they count as
       ``fit_words`` at most, or larger tables would leave the items no place in it.
    2. Every text is cut into blocks of 16 words; for each item the windows just long
       enough to hold it are compared with it: the cosine between the window and the
       item's place in the latent space. Windows at ``least`` or more are candidates,
       all of them.
    3. A candidate and a block on either side is compared word by word: the longest
       common subsequence must have ``sure`` of the item's words, or ``likely`` of
       them if the item's last sentence, the answer, is in the window as it is.

    Items are taken 256 at a time, so a task never holds more; documents are read twice
    for weights and space, and once for each such block. Words are lower-case (A-Z), between white space.

    Defined cases: null and empty texts and items match nothing; null ids stay null in
    the result; repeated documents and repeated items give repeated rows; an item of
    one sentence has no answer to check; only doc_id, item_id and text are read; an
    empty table gives no rows. Returns doc_id, item_id, item_words, common_words,
    has_answer.
    """
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = documents.sparkSession.createDataFrame([], MATCH)
    for shared in _blocks_of_items(documents, benchmark, fit_words):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                rows = []
                for piece in arrays.slices(batch, "text", PIECE):
                    ids = piece.column(0).to_pylist()
                    found = leaks(*_tokens(piece.column(1)), items, least, sure, likely)
                    rows += [(ids[doc], items.ids[i], int(items.lengths[i]), common, has) for (doc, i), (common, has) in found.items()]
                if rows:
                    doc, item, length, common, has = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(length, pa.int32()), pa.array(common, pa.int32()), pa.array(has)],
                                                     ["doc_id", "item_id", "item_words", "common_words", "has_answer"])

        out = out.unionByName(held.mapInArrow(run, MATCH))
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.18, sure: float = 0.8, likely: float = 0.6, fit_words: int = 500_000) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are; see ``find_leaks``."""
    out, at = documents, documents.columns.index("text")
    for shared in _blocks_of_items(documents, benchmark, fit_words):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                for piece in arrays.slices(batch, "text", PIECE):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[doc for doc, _ in leaks(*_tokens(piece.column(at)), items, least, sure, likely)]] = False
                    yield piece.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
    return out
