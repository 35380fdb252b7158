"""Substring dedup: fixed-block anchors, extended to maximal exact repeats."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import arrays, units

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROBE = 6  # bytes of a probe's hash that travel, beside the bits of its bucket
WINDOW = 8
RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: long, stop: long>>"


def _words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.text_bytes(column)
    starts, ends, first = arrays.word_spans(data, offsets)
    return arrays.word_hashes(data, starts, ends), first


def _windows(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and their hashes."""
    found = arrays.windows_hash(arrays.prefix_sums(hashes), length)
    starts = np.flatnonzero(arrays.room(first, len(hashes)) >= length)
    return starts, found[starts]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def remove_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """Remove every word in a window of ``window`` words that also starts earlier.

    1. Every text is cut into non-overlapping blocks of ``window // 2`` words: the
       reference blocks. Any window holds one whole block of its own text. All
       units send their blocks to the index, and every rolling window of a block's
       length probes it, so the earlier of two equal windows always has a block
       that a probe of the later one hits.
    2. Hits are extended: each window of ``window`` words around a hit is compared
       with all others by its hash, and each is told whether an earlier unit has it.
       Inside a unit, documents stand in order and decide among themselves.
    3. Windows that start earlier elsewhere cover words; what they cover together
       are the maximal exact repeats.

    No pair of occurrences is ever formed. Windows are compared by 64 bits, the
    first probe by 48 and those of its bucket.

    Defined cases: null and empty text have no words and stay; a null ``doc_id``
    comes after all others, in the order of texts; of equal ids the smaller text is
    first, so a repeated row loses all that its first copy has; only ``doc_id`` and
    ``text`` are read, other columns do not matter; an empty table gives no rows.
    Returns doc_id, n_words, n_removed, kept (words joined by a space), removed
    (maximal runs of removed words).
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    block = max(1, window // 2)
    plan = units.layout(documents)
    bits = plan.bits
    probe_mask, window_mask = units.cut(bits, PROBE), units.cut(bits, WINDOW)

    def probes(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        hashes, first = _words(piece.column("text"))
        starts, found = _windows(hashes, first, block)
        is_block = (arrays.place(first, len(hashes))[starts] % block == 0).astype(np.uint64)
        # The last bit tells blocks while sorting; keys never have it, whatever the mask keeps.
        found = np.sort(found & ~np.uint64(3) | is_block)
        whole = found & ~np.uint64(3) & probe_mask
        fresh = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, int)
        if not len(fresh):
            return whole, None
        counts = np.diff(np.concatenate([fresh, [len(whole)]]))
        return whole[fresh], np.maximum.reduceat((found & np.uint64(1)).astype(np.uint8), fresh) | (counts > 1).astype(np.uint8) * np.uint8(2)

    def index(table: pa.Table) -> pa.Table:
        keys, row, flags, first = units.met(table, PROBE, np.uint8)
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        both = np.bitwise_or.reduceat(flags, first)
        hit = (both & 1 > 0) & ((sizes > 1) | (both & 2 > 0))
        chosen = np.repeat(hit, sizes)
        return units.answers(table, keys[chosen], row[chosen], None, PROBE)

    def extend(left: pa.Table, replies: pa.Table) -> pa.Table:
        live, _ = units.answered(replies, bits, PROBE)
        texts = units.unpack(left)
        none = pa.table(units.requests(0, np.zeros(0, np.uint64), None, bits, WINDOW).to_pydict(), schema=_request_schema())
        if not len(live) or not texts.num_rows:
            return none
        at = int(left.column("unit")[0].as_py())
        hashes, first = _words(texts.column("text"))
        starts, found = _windows(hashes, first, block)
        hit = np.zeros(len(hashes) + 1, np.int64)
        hit[starts[units.among(found & ~np.uint64(3) & probe_mask, live)] + 1] = 1
        before = np.cumsum(hit)
        starts, found = _windows(hashes, first, window)
        near = before[starts + window - block + 1] > before[starts]
        return pa.Table.from_batches([units.requests(at, _distinct(found[near] & window_mask), None, bits, WINDOW)])

    def decide(table: pa.Table) -> pa.Table:
        keys, row, _, first = units.met(table, WINDOW)
        # Entries of a hash stand in the order of units: all but the first are later.
        later = np.ones(len(keys), bool)
        later[first] = False
        return units.answers(table, keys[later], row[later], None, WINDOW)

    def erase(left: pa.Table, replies: pa.Table) -> pa.Table:
        earlier, _ = units.answered(replies, bits, WINDOW)
        texts = units.unpack(left)
        hashes, first = _words(texts.column("text"))
        starts, found = _windows(hashes, first, window)
        found &= window_mask
        gone = units.among(found, earlier)
        order = np.argsort(found, kind="stable")
        again = np.zeros(len(found), bool)
        again[order[1:]] = found[order[1:]] == found[order[:-1]]
        flags = arrays.covered(starts[gone | again], window, len(hashes))
        return _cleaned(texts, flags, first)

    sent = units.ask(documents, plan, probes, PROBE)
    extended = units.with_replies(documents, plan, units.reply(sent, index), extend, units.REQUEST)
    return units.with_replies(documents, plan, units.reply(extended, decide), erase, RESULT)


def _request_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("hashes", pa.binary()), ("extra", pa.binary())])


def _kept(texts: Iterable[str | None], flags: np.ndarray, first: np.ndarray) -> list[str]:
    out = []
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        own = flags[first[i]:first[i + 1]]
        out.append(b" ".join(compress(words, ~own) if own.any() else words).decode())
    return out


def _cleaned(texts: pa.Table, flags: np.ndarray, first: np.ndarray) -> pa.Table:
    sums = np.concatenate([[0], np.cumsum(flags)])
    # A run never passes from one text to the next: cut runs at the texts' edges.
    opens = flags.copy()
    opens[1:] &= ~flags[:-1]
    edge = first[:-1][first[:-1] < len(flags)]
    opens[edge] = flags[edge]
    starts = np.flatnonzero(opens)
    doc = np.searchsorted(first, starts, "right") - 1
    stops = np.concatenate([starts[1:], [len(flags)]]) if len(starts) else starts
    stops = starts + (sums[stops] - sums[starts]) if len(starts) else starts
    spans = pa.StructArray.from_arrays([pa.array(starts - first[doc], pa.int64()), pa.array(stops - first[doc], pa.int64())], ["start", "stop"])
    offsets = pa.array(np.searchsorted(doc, np.arange(texts.num_rows + 1)).astype(np.int32))
    return pa.table({
        "doc_id": texts.column("doc_id"), "n_words": pa.array(np.diff(first).astype(np.int64)), "n_removed": pa.array(np.diff(sums[first]).astype(np.int64)),
        "kept": pa.array(_kept((x.as_py() for x in texts.column("text")), flags, first), pa.string()), "removed": pa.ListArray.from_arrays(offsets, spans),
    })
