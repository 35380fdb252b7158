"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Bytes that begin a code point of a word: none of a continuation, no white space.
POINTS = ~arrays.GAPS
POINTS[0x80:0xC0] = False
PIECE = 1 << 19
BLOCK = 64
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, toxicity double, kept boolean"
COUNTS = "kind int, block long, a array<long>, b array<long>"
DEFAULTS = {"threshold": -0.15, "buckets": 1 << 16, "longest": 2, "least_words": 50, "most_repeated": 0.5, "max_trusted": 200_000, "most_toxic": 1.6, "toxic_buckets": 1 << 18}
# ASCII letters in lower case, other ASCII signs than letters and digits blank.
PLAIN = arrays.LOWER.copy()
PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
STRONGEST = 3


def _features(words: np.ndarray, first: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of one to ``longest`` words, and the text it is in."""
    sums, room = arrays.prefix_sums(words), arrays.room(first, len(words))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found, owner = [], []
    for n in range(1, longest + 1):
        starts = np.flatnonzero(room >= n)
        found.append((arrays.windows_hash(sums, n)[starts] % np.uint64(buckets)).astype(np.int64))
        owner.append(doc[starts])
    return np.concatenate(found), np.concatenate(owner)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.text_bytes(column)
    data = arrays.LOWER[data]
    starts, ends, first = arrays.word_spans(data, offsets)
    return arrays.word_hashes(data, starts, ends), first


def _plain_words(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word without signs, and the text it is in."""
    data, offsets = arrays.text_bytes(column)
    data = PLAIN[data]
    starts, ends, first = arrays.word_spans(data, offsets)
    return (arrays.word_hashes(data, starts, ends) % np.uint64(buckets)).astype(np.int64), np.repeat(np.arange(len(first) - 1), np.diff(first))


def _once(found: np.ndarray, owner: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once a text."""
    pairs = np.unique(owner * buckets + found)
    return pairs % buckets, pairs // buckets


def toxicity(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the ``STRONGEST`` different words of every text."""
    found, owner = _plain_words(column, len(weights))
    heavy = weights[found] > 0
    found, owner = _once(found[heavy], owner[heavy], len(weights))
    order = np.lexsort((-weights[found], owner))
    top = np.arange(len(order)) - np.searchsorted(owner, owner) < STRONGEST
    return np.bincount(owner[top], weights[found[order[top]]].astype(np.float64), len(column)) / STRONGEST


def _twice(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys within their text: which occur twice or more, and which are not the first."""
    mixed = arrays.mix(keys ^ arrays.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order[1:][same]] = many[order[:-1][same]] = later[order[1:][same]] = True
    return many, later


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of flagged bytes of every text."""
    ends = offsets.tolist()
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(ends, ends[1:])], np.int64)


def base_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every whole text: words, their code points, symbols, repeated lines, words in repeated 3-word windows."""
    data, offsets = arrays.text_bytes(column)
    starts, ends, first = arrays.word_spans(data, offsets)
    words = arrays.word_hashes(data, starts, ends)
    n = len(words)
    # Windows of three words.
    threes = np.flatnonzero(arrays.room(first, n) >= 3)
    many, _ = _twice(arrays.windows_hash(arrays.prefix_sums(words), 3)[threes], np.searchsorted(first, threes, "right"))
    repeated = np.concatenate([[0], np.cumsum(arrays.covered(threes[many], 3, n))])
    # Lines end at \n or with the text.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    doc = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, line_starts)], offsets[doc + 1])
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, doc = line_starts[worded], line_ends[worded], doc[worded]
    _, later = _twice(arrays.word_hashes(data, line_starts, line_ends), doc)
    return {
        "n_words": np.diff(first).astype(np.int64), "word_chars": _per_text(POINTS[data], offsets), "n_symbols": _per_text(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(doc[later], minlength=len(column)).astype(np.int64), "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]],
    }


def marked_ids(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and mark of labelled rows: 1 trusted (quality 1 and not toxic), 2 toxic; each spread by hash to ``most`` rows or so if there are more."""
    ids = F.col("doc_id").cast("long").alias("doc_id")
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(ids).distinct()
    bad = labels.where("quality = 0 or toxic = 1").select(ids)
    toxic = labels.where("toxic = 1 and doc_id is not null").select(ids).distinct()
    both = good.join(bad, "doc_id", "left_anti").withColumn("mark", F.lit(1)).union(toxic.withColumn("mark", F.lit(2)))
    found = {row["mark"]: row["count"] for row in both.groupBy("mark").count().collect()}
    most_of = F.when(F.col("mark") == 1, F.lit(max(found.get(1, 0), most))).otherwise(F.lit(max(found.get(2, 0), most)))
    return both.where(F.pmod(F.xxhash64("doc_id"), most_of) < most)


def _blocks(totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Both counts of each kind as rows of ``BLOCK`` buckets, without rows of zeros."""
    for kind, both in enumerate(totals):
        a, b = np.pad(both, ((0, 0), (0, -both.shape[1] % BLOCK))).reshape(2, -1, BLOCK)
        full = np.flatnonzero(a.any(1) | b.any(1))
        ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), kind, np.int32)), pa.array(full), *(pa.ListArray.from_arrays(ends, pa.array(v[full].ravel())) for v in (a, b))], ["kind", "block", "a", "b"])


def _added(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int]) -> list[np.ndarray]:
    """Both counts of each kind, summed over the rows of ``_blocks``."""
    totals = [np.zeros((2, -(-size // BLOCK), BLOCK), np.int64) for size in sizes]
    for batch in batches:
        kind, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for which, column in enumerate(batch.columns[2:]):
            rows = column.flatten().to_numpy().reshape(-1, BLOCK)
            for k, total in enumerate(totals):
                np.add.at(total[which], block[kind == k], rows[kind == k])
    return [total.reshape(2, -1)[:, :size] for total, size in zip(totals, sizes)]


def ratios(documents: DataFrame, marked: DataFrame, buckets: int, longest: int, toxic_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios by bucket, counted in one pass: of n-grams between trusted text and the raw corpus, of words between toxic and trusted documents.

    n-grams are multinomials with one added to each count. A word counts once a
    document; trusted documents are scaled to as many as there are toxic ones, and
    one is added to both, so that a word of a single toxic document weighs little.
    """

    # The last place of the second kind counts documents.
    sizes = buckets, toxic_buckets + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (raw, target), (toxic, clean) = totals = [np.zeros((2, size), np.int64) for size in sizes]
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                found, owner = _features(*_lowered(piece.column(0)), buckets, longest)
                raw += np.bincount(found, minlength=buckets)
                mark = piece.column(1).to_numpy(zero_copy_only=False)
                target += np.bincount(found[mark[owner] == 1], minlength=buckets)
                for counts, which in ((clean, mark == 1), (toxic, mark == 2)):
                    if which.any():
                        words, _ = _once(*_plain_words(piece.column(0).filter(pa.array(which)), toxic_buckets), toxic_buckets)
                        np.add.at(counts, words, 1)
                        counts[-1] += which.sum()
        yield from _blocks(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(_added(batches, sizes))

    # At most twice max_trusted ids.
    texts = documents.join(F.broadcast(marked), "doc_id", "left").select("text", F.coalesce("mark", F.lit(0)).alias("mark"))
    # A task has every bucket once already, so its counts go to their sums as they are, blocks of buckets a row: no table of buckets in the JVM.
    counts = texts.mapInArrow(count, COUNTS).repartition("kind", "block").mapInArrow(add, COUNTS)
    # At most one row a block of either kind.
    (raw, target), (toxic, clean) = (both.astype(np.float64) for both in _added(counts.toArrow().to_batches(), sizes))
    good = np.log((target + 1) / (target.sum() + buckets) * (raw.sum() + buckets) / (raw + 1)) if target.sum() else np.zeros(buckets)
    bad = np.log((toxic[:-1] + 1) / (clean[:-1] * toxic[-1] / max(clean[-1], 1) + 1))
    return good.astype(np.float32), bad.astype(np.float32)


def score_documents(
    documents: DataFrame, labels: DataFrame, threshold: float = DEFAULTS["threshold"], buckets: int = DEFAULTS["buckets"], longest: int = DEFAULTS["longest"],
    least_words: int = DEFAULTS["least_words"], most_repeated: float = DEFAULTS["most_repeated"], max_trusted: int = DEFAULTS["max_trusted"],
    most_toxic: float = DEFAULTS["most_toxic"], toxic_buckets: int = DEFAULTS["toxic_buckets"],
) -> DataFrame:
    """Base counts of every document, whether these fail, its score and whether it is kept.

    Two multinomials over ``buckets`` hashed n-grams of up to ``longest`` lower-case
    words: one of trusted documents (labelled good and not toxic; all of them up to
    ``max_trusted``, beyond it a fixed share of ids that gives about as many), one of
    the whole raw corpus. A document's score is the mean over its n-grams of the log
    of their ratio, so its length does not matter; it is kept if the score is
    ``threshold`` or more. The same documents always give the same answer.

    A few toxic words do not move that mean, so a second ratio of hashed words, toxic
    against trusted documents, is averaged over the three strongest different words
    of a document, whatever its length; at ``most_toxic`` or more it is not kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` of
    its words in 3-word windows that occur twice in it. Such documents are not kept.

    Defined cases: null and empty texts have no words and fail; without trusted
    documents every score is 0, without toxic labels every toxicity; repeated rows are scored alike and count each time;
    a null doc_id is never trusted; null labels are not trusted; an id labelled both
    ways is not trusted; only the named columns are read; an empty table gives no
    rows.
    """
    judge = _judge(documents, labels, threshold, buckets, longest, least_words, most_repeated, max_trusted, most_toxic, toxic_buckets)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "toxicity", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                found = judge(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(found[c]) for c in names)], ["doc_id", *names])

    return _texts(documents).mapInArrow(run, RESULT)


def keep_documents(documents: DataFrame, labels: DataFrame, **rules: float) -> DataFrame:
    """The documents that ``score_documents`` keeps, all columns as they are."""
    judge, at = _judge(documents, labels, **(DEFAULTS | rules)), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.slices(batch, "text", PIECE):
                yield piece.filter(pa.array(judge(piece.column(at))["kept"], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _judge(documents: DataFrame, labels: DataFrame, threshold: float, buckets: int, longest: int, least_words: int, most_repeated: float, max_trusted: int, most_toxic: float, toxic_buckets: int) -> Callable[[pa.Array], dict[str, np.ndarray]]:
    """The verdict on a column of texts, by ratios counted over all documents."""
    # A number a bucket, whatever the corpus.
    shared = documents.sparkSession.sparkContext.broadcast(ratios(_texts(documents), marked_ids(labels, max_trusted), buckets, longest, toxic_buckets))

    def judge(column: pa.Array) -> dict[str, np.ndarray]:
        out, (good, bad) = base_statistics(column), shared.value
        found, owner = _features(*_lowered(column), buckets, longest)
        n = np.bincount(owner, minlength=len(column))
        out["score"] = np.bincount(owner, good[found].astype(np.float64), len(column)) / np.maximum(n, 1)
        out["base_failed"] = (out["n_words"] < least_words) | (out["n_repeat_words"] > most_repeated * out["n_words"])
        out["toxicity"] = toxicity(column, bad)
        out["kept"] = ~out["base_failed"] & (out["score"] >= threshold) & (out["toxicity"] < most_toxic)
        return out

    return judge
