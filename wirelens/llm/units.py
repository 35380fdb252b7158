"""Questions that every part of the corpus asks about all other parts.

Documents fall into units, ranges of ids of a few megabytes, so that the order of
units is the order of documents. A unit sends the sorted, distinct hashes of its
windows, cut by leading bits into buckets. A bucket meets what all units sent for
its hashes, and answers each unit. Within a unit a hash is sent once however often
it occurs, so a passage that is in a third of all documents costs one entry a unit.

Sorted hashes travel as differences, byte plane by byte plane and compressed, so the
bits that their order gives away cost nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REQUEST = "bucket int, unit long, hashes binary, extra binary"
REPLY = "unit long, bucket int, hashes binary, extra binary"


# Quantiles of the ids that are known at most; ranges between them are cut evenly.
RANGES = 1024


@dataclass(frozen=True)
class Layout:
    """How a corpus is cut: ranges of ids by their starts, each in equal parts, make units; leading bits of hashes make buckets."""

    starts: tuple[int, ...]
    widths: tuple[int, ...]
    parts: int
    spread: int
    bits: int

    def number(self, ids: np.ndarray) -> np.ndarray:
        """Unit of every id: units are in the order of ids."""
        starts = np.array(self.starts, np.int64)
        at = np.maximum(np.searchsorted(starts, ids, "right") - 1, 0)
        return at * self.parts + np.minimum((ids - starts[at]) // np.array(self.widths, np.int64)[at], self.parts - 1)

    @property
    def last(self) -> int:
        """First unit behind those of ids: rows without an id follow from there."""
        return len(self.starts) * self.parts


def layout(documents: DataFrame, unit_bytes: int = 4 << 20, least_units: int = 384, bucket_bytes: int = 2 << 20) -> Layout:
    """One pass over lengths and ids. Sizes and ids change the layout only, never a result.

    Ranges hold about as many documents each, however the ids lie, so a few ids far
    away from the others do not make a unit large.
    """
    places = [i / RANGES for i in range(1, RANGES)]
    row = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.col("text").cast("string")).cast("long").alias("size")).agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("size").alias("size"), F.percentile_approx("doc_id", places, 20 * RANGES).alias("at")).first()
    low, high, size = row["low"] or 0, row["high"] or 0, max(row["size"] or 0, 1)
    wanted = max(1, -(-size // unit_bytes), min(least_units, size // (64 << 10)))
    ranges = min(wanted, RANGES)
    known = row["at"] or []
    starts = sorted({low, *(known[i * RANGES // ranges - 1] for i in range(1, ranges) if known)})
    parts = -(-wanted // ranges)
    widths = [max(1, -(-(end - start) // parts)) for start, end in zip(starts, [*starts[1:], high + 1], strict=True)]
    return Layout(tuple(starts), tuple(widths), parts, wanted, min(24, int(max(16, size // bucket_bytes)).bit_length()))


def rows(documents: DataFrame, plan: Layout) -> DataFrame:
    """What tasks read: id, text, and where a row without an id goes, by its text."""
    text = F.col("text").cast("string")
    slot = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(text), F.lit(plan.spread))).otherwise(F.lit(0))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), slot.cast("long").alias("slot"))


def by_unit(batches: Iterator[pa.RecordBatch], plan: Layout) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each unit in each batch; long stretches in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        units = np.where(ids.is_null().to_numpy(zero_copy_only=False), plan.last + batch.column(2).to_numpy(), plan.number(ids.fill_null(0).to_numpy()))
        if (np.diff(units) < 0).any():
            order = np.argsort(units, kind="stable")
            batch, units = batch.take(pa.array(order)), units[order]
        edges = np.flatnonzero(np.diff(units)) + 1
        for start, end in zip([0, *edges], [*edges, len(units)], strict=True):
            for piece in arrays.slices(batch.slice(start, end - start), "text", 8 << 20):
                yield int(units[start]), piece


def packed(documents: DataFrame, plan: Layout) -> DataFrame:
    """The texts as compressed pieces of a unit, for the shuffle that brings a unit together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, piece in by_unit(batches, plan):
            sink = pa.BufferOutputStream()
            held = piece.select(["doc_id", "text"])
            with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(held)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["unit", "texts"])

    return rows(documents, plan).mapInArrow(pack, "unit long, texts binary")


def unpack(pieces: pa.Table) -> pa.Table:
    """A unit's documents in their order: by id, none last, then by text."""
    tables = [pa.ipc.open_stream(x.as_py()).read_all() for x in pieces.column("texts")]
    if not tables:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    table = pa.concat_tables(tables)
    ids = table.column("doc_id")
    known = ids.fill_null(0).to_numpy()
    if ids.null_count or len(known) > 1 and not (np.diff(known) > 0).all():
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table.combine_chunks()


def packed_bytes(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True) if body else b""


def unpacked_bytes(held: bytes) -> bytes:
    return pa.decompress(held[8:], int.from_bytes(held[:8], "little"), "zstd", asbytes=True) if held else b""


def planes(values: np.ndarray, width: int) -> bytes:
    """The leading bytes of sorted numbers, as differences: first bytes of all, then second ones, and so on."""
    values = values >> np.uint64(64 - 8 * width)
    steps = np.diff(values, prepend=np.uint64(0))
    return packed_bytes(np.ascontiguousarray(steps.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T).tobytes())


def unplanes(held: bytes, width: int) -> np.ndarray:
    table = np.frombuffer(unpacked_bytes(held), np.uint8).reshape(width, -1)
    steps = np.zeros((table.shape[1], 8), np.uint8)
    steps[:, 8 - width:] = table.T
    return np.cumsum(steps.view(">u8").ravel().astype(np.uint64), dtype=np.uint64) << np.uint64(64 - 8 * width)


def requests(at: int, hashes: np.ndarray, extra: np.ndarray | None, bits: int, width: int, kind: int = 0) -> pa.RecordBatch:
    """Sorted hashes of a unit, one row a bucket. extra: one item a hash. Each kind of hash has buckets of its own."""
    edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(hashes)]])
    full = np.flatnonzero(ends > starts)
    rest = hashes << np.uint64(bits)
    return pa.RecordBatch.from_arrays([
        pa.array((full + (kind << bits)).astype(np.int32)), pa.array(np.full(len(full), at, np.int64)),
        pa.array([planes(rest[starts[b]:ends[b]], width) for b in full], pa.binary()),
        pa.array([b"" if extra is None else packed_bytes(extra[starts[b]:ends[b]].tobytes()) for b in full], pa.binary()),
    ], ["bucket", "unit", "hashes", "extra"])


def met(table: pa.Table, width: int, kind: np.dtype | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """All entries of a bucket in the order of their hash, then unit: hash, row, extra; and where each hash begins."""
    units = table.column("unit").to_numpy()
    order = np.argsort(units, kind="stable")
    held = [unplanes(table.column("hashes")[int(i)].as_py(), width) for i in order]
    keys = np.concatenate(held)
    row = np.repeat(order, [len(x) for x in held])
    sort = np.argsort(keys, kind="stable")
    keys, row = keys[sort], row[sort]
    extra = None
    if kind is not None:
        extra = np.concatenate([np.frombuffer(unpacked_bytes(table.column("extra")[int(i)].as_py()), kind) for i in order])[sort]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys, row, extra, first


def answers(table: pa.Table, keys: np.ndarray, row: np.ndarray, extra: np.ndarray | None, width: int) -> pa.Table:
    """Give chosen entries back to the units whose rows they are, still in order."""
    order = np.argsort(row, kind="stable")
    keys, row = keys[order], row[order]
    extra = extra[order] if extra is not None else None
    edges = np.flatnonzero(np.diff(row)) + 1
    starts, ends = np.concatenate([[0], edges]).astype(int), np.concatenate([edges, [len(row)]]).astype(int)
    full = [(s, e) for s, e in zip(starts, ends, strict=True) if e > s]
    at = [int(row[s]) for s, _ in full]
    return pa.table({
        "unit": table.column("unit").take(pa.array(at, pa.int64())).cast(pa.int64()), "bucket": table.column("bucket").take(pa.array(at, pa.int64())).cast(pa.int32()),
        "hashes": pa.array([planes(keys[s:e], width) for s, e in full], pa.binary()),
        "extra": pa.array([b"" if extra is None else packed_bytes(extra[s:e].tobytes()) for s, e in full], pa.binary()),
    })


def answered(replies: pa.Table, bits: int, width: int, kind: np.dtype | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The hashes that a unit got back, sorted and distinct, with their extras."""
    if not replies.num_rows:
        return np.zeros(0, np.uint64), None if kind is None else np.zeros(0, kind)
    held = [unplanes(x.as_py(), width) for x in replies.column("hashes")]
    tops = (replies.column("bucket").to_numpy() & ((1 << bits) - 1)).astype(np.uint64) << np.uint64(64 - bits)
    keys = np.concatenate([top | (x >> np.uint64(bits)) for top, x in zip(tops, held, strict=True)])
    keys, index = np.unique(keys, return_index=True)
    if kind is None:
        return keys, None
    return keys, np.concatenate([np.frombuffer(unpacked_bytes(x.as_py()), kind) for x in replies.column("extra")])[index]


def cut(bits: int, width: int) -> np.uint64:
    """What is left of a hash after its way through a bucket."""
    kept = min(64, bits + 8 * width)
    return np.uint64(((1 << kept) - 1) << (64 - kept))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def ask(documents: DataFrame, plan: Layout, entries: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]], width: int) -> DataFrame:
    """Requests of all units, straight from a scan."""
    bits = plan.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, piece in by_unit(batches, plan):
            hashes, extra = entries(piece)
            if len(hashes):
                yield requests(at, hashes, extra, bits, width)

    return rows(documents, plan).mapInArrow(run, REQUEST)


def reply(sent: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Answers of all buckets."""
    return sent.groupBy("bucket").applyInArrow(answer, REPLY)


def with_replies(documents: DataFrame, plan: Layout, replies: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Bring every unit's documents together with its answers."""
    right = replies.groupBy("unit")
    return packed(documents, plan).groupBy("unit").cogroup(right).applyInArrow(lambda left, held: work(left, held), schema)
