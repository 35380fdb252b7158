"""Numpy views of text columns: bytes, words, and hashes of all windows at once.

A window's hash is a difference of prefix sums of ``value * base**position`` modulo
2**64, divided by ``base**start`` (the base is odd, so it has an inverse), and mixed.
Every window length therefore costs the same few passes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# White space between words: the space and the five controls from tab to return.
GAPS = np.zeros(256, bool)
GAPS[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPAN = 1 << 15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below n; kept for the next batch."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 1 << 24:
            _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values in each [start, end)."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts])


def windows_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window of that length at every start."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[length:] - sums[:n]) * powers(INVERSE, n))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text."""
    inside = ~GAPS[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word; words stand in order. Some SPAN bytes at a time, a whole word at least: what they need stays in the processor's cache."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + SPAN, "right")))
        part = data[low:ends[upto - 1]].astype(np.uint64)
        part += np.uint64(1)
        out[at:upto] = spans_hash(prefix_sums(part), starts[at:upto] - low, ends[at:upto] - low)
        at = upto
    return out


def room(first: np.ndarray, n: int) -> np.ndarray:
    """For every item, how many items its text still has from there; first: items before each text."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(n)


def place(first: np.ndarray, n: int) -> np.ndarray:
    """For every item, its place in its text."""
    return np.arange(n) - np.repeat(first[:-1], np.diff(first))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of that length at one of the starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cut a batch into pieces of about that many bytes of text, a whole text at least."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_bytes(column)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
