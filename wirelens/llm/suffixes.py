"""Suffix-array dedup: a collection's suffixes built column by column over anchored pieces."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import arrays, units

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 32  # bytes of an anchor
PLACES = np.uint64((1 << 24) - 1)
PROBE = 6
# An anchor that more units have than this is compared window by window.
HOT = 128
# Pieces compared at a time, apart from those of one anchor.
BLOCK = 8192
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start: long, stop: long>>"


@dataclass
class Pieces:
    """Runs of windows that share an anchor: first and last window, anchor, hash of the anchor, hash of the bytes."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    kind: np.ndarray
    content: np.ndarray


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every span of values, by running minima from both ends of blocks of that length."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], ahead[span - 1:n])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Pieces:
    """Cut texts into pieces whose windows of that length share their least anchor, the leftmost of equals."""
    n, span = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return Pieces(none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    sums = arrays.prefix_sums(data.astype(np.uint64) + np.uint64(1))
    grams = arrays.windows_hash(sums, GRAM)
    places = np.arange(len(grams), dtype=np.uint64) & PLACES
    least = _least(grams & ~PLACES | places, span) & PLACES
    starts = np.arange(len(least))
    anchor = starts + ((least - places[: len(least)]) & PLACES).astype(np.int64)
    whole = _inside(offsets, length, len(least))
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    # Two texts may follow each other without a gap between their windows.
    opens[offsets[:-1][offsets[1:] - offsets[:-1] >= length]] = True
    first = np.flatnonzero(opens)
    closes = whole.copy()
    closes[:-1] &= ~whole[1:] | opens[1:]
    last = np.flatnonzero(closes)
    at = anchor[first]
    return Pieces(first, last, at, grams[at], arrays.spans_hash(sums, first, last + length))


def earliest(kind: np.ndarray, unit: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Least unit that has each window, for pieces laid with their anchors in one column.

    One symbol of every piece is put before its suffix in each round, from the last
    column to the first. A stable sort by (anchor, symbol) takes the order of the
    suffixes one column to the left: the symbols in that order are the column's part
    of the collection's Burrows-Wheeler transform. The common prefix of two
    neighbours is one more than the least one between them in the round before.
    Equal windows always stand in the same column, so a round's suffixes are the
    only ones that need be compared; neighbours with ``length`` symbols in common
    are the occurrences of one window. Every round reads the arrays front to back.
    """
    k, columns = text.shape
    order = np.argsort(kind, kind="stable")
    common = np.zeros(k + 1, np.int32)
    rank = np.zeros(k, np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], kind[order][1:] != kind[order][:-1]]))
    found = np.repeat(unit[:, None], columns - length + 1, axis=1)
    stop = 256
    for column in range(columns - 1, -1, -1):
        symbol = text[order, column].astype(np.int64)
        symbol[(column < low[order]) | (column >= high[order])] = stop
        key = rank[order] * (stop + 1) + symbol
        moved = np.argsort(key, kind="stable")
        key, symbol = key[moved], symbol[moved]
        fresh = np.zeros(k + 1, np.int32)
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] != stop))
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[0::2], between[1::2] = moved[same] + 1, moved[same + 1] + 1
            fresh[same + 1] = np.minimum(np.minimum.reduceat(common, between)[0::2] + 1, length)
        order, common = order[moved], fresh
        if column <= columns - length:
            opens = np.flatnonzero(common[:k] < length)
            least = np.minimum.reduceat(unit[order], opens)
            found[order, column] = np.repeat(least, np.diff(np.concatenate([opens, [k]])))
    return found


def _send(at: int, data: np.ndarray, found: Pieces, chosen: np.ndarray, length: int, bits: int) -> pa.RecordBatch:
    """Chosen pieces of a unit, a row for each bucket of anchors."""
    chosen = chosen[np.argsort(found.kind[chosen], kind="stable")]
    bucket = (found.kind[chosen] >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate([[0], edges]).astype(int), np.concatenate([edges, [len(chosen)]]).astype(int)
    hashes, bodies, tops = [], [], []
    for s, e in zip(starts, ends, strict=True):
        own = chosen[s:e]
        if not len(own):
            continue
        sizes = found.last[own] - found.first[own] + length
        step = np.repeat(found.first[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        head = np.stack([sizes.astype(np.int32), (found.anchor[own] - found.first[own]).astype(np.int32)])
        hashes.append(found.kind[own].tobytes() + found.content[own].tobytes())
        body = head.tobytes() + data[np.arange(len(step)) + step].tobytes()
        bodies.append(len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True))
        tops.append(int(bucket[s]))
    return pa.RecordBatch.from_arrays([pa.array(tops, pa.int32()), pa.array([at] * len(tops), pa.int64()), pa.array(hashes, pa.binary()), pa.array(bodies, pa.binary())], ["bucket", "unit", "hashes", "extra"])


def remove_repeated_bytes(documents: DataFrame, length: int = 100) -> DataFrame:
    """Remove every byte in a string of ``length`` bytes that also starts earlier.

    1. Every window of ``length`` bytes is led by its anchor, the least of its
       32-byte grams by hash. Runs of windows with one anchor are pieces of at most
       ``2 * length - 32`` bytes; equal windows have equal anchors at equal places.
       Anchors that occur once in the whole collection can't be in a repeat: units
       exchange the hashes of their anchors and keep the pieces of the others.
    2. The distinct pieces of an anchor are the documents of a collection. Its
       suffixes are built column by column (``earliest``), one symbol per piece each
       round, with the transform's order and the common prefixes taken from round to
       round. Windows with ``length`` symbols in common learn the first unit that
       has them.
       An anchor in more than ``HOT`` units may have any number of different
       surroundings; its windows are exchanged by their hashes instead, so no task
       gathers them.
    3. Each unit removes the windows that an earlier unit has, or that it has itself
       before.

    Defined cases: null is the empty text and stays; a null ``doc_id`` comes after
    all others, in the order of texts; of equal ids the smaller text is first;
    texts shorter than ``length`` stay; only ``doc_id`` and ``text`` are read; an
    empty table gives no rows. Pieces are told apart by 64 bits of hash beside
    their anchor's. Returns doc_id, n_bytes, n_removed, n_spans, kept (bytes that
    stay), removed (maximal runs of removed bytes).
    """
    if length <= GRAM:
        raise ValueError(f"a window is longer than {GRAM} bytes")
    plan = units.layout(documents)
    bits, places = plan.bits, length - GRAM
    hot_units = HOT
    mask = units.cut(bits, PROBE)

    def probes(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        held = [pieces(*arrays.text_bytes(part.column("text")), length).kind for part in arrays.slices(piece, "text", 1 << 20)]
        kinds = np.sort(np.concatenate(held) & mask)
        fresh = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, int)
        return kinds[fresh], (np.diff(np.concatenate([fresh, [len(kinds)]])) > 1).astype(np.uint8)

    def repeated(table: pa.Table) -> pa.Table:
        keys, row, many, first = units.met(table, PROBE, np.uint8)
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        chosen = np.repeat((sizes > 1) | (np.maximum.reduceat(many, first) > 0), sizes)
        hot = np.repeat(sizes > hot_units, sizes).astype(np.uint8)
        return units.answers(table, keys[chosen], row[chosen], hot[chosen], PROBE)

    def gather(left: pa.Table, replies: pa.Table) -> pa.Table:
        live, hot = units.answered(replies, bits, PROBE, np.uint8)
        texts = units.unpack(left)
        at = int(left.column("unit")[0].as_py()) if left.num_rows else 0
        data, offsets = arrays.text_bytes(texts.column("text"))
        found = pieces(data, offsets, length)
        is_hot = units.among(found.kind & mask, live[hot > 0])
        chosen = np.flatnonzero(units.among(found.kind & mask, live) & ~is_hot)
        _, once = np.unique(found.content[chosen], return_index=True)
        windows = np.unique(_window_hashes(data, length)[_windows(found, np.flatnonzero(is_hot))])
        return pa.Table.from_batches([_send(at, data, found, chosen[once], length, bits), units.requests(at, windows, None, bits, 8, kind=1)])

    def compare(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >> bits:
            # Windows of hot anchors: all units but the first that has one are told.
            keys, row, _, first = units.met(table, 8)
            later = np.ones(len(keys), bool)
            later[first] = False
            return units.answers(table, keys[later], row[later], None, 8)
        unit = table.column("unit").to_numpy()
        rank = np.unique(unit, return_inverse=True)[1].astype(np.int32)
        kinds, contents, owners, sizes, leads, bodies = [], [], [], [], [], []
        for i in range(table.num_rows):
            pair = np.frombuffer(table.column("hashes")[i].as_buffer(), np.uint64).reshape(2, -1)
            held = table.column("extra")[i].as_py()
            body = pa.decompress(held[8:], int.from_bytes(held[:8], "little"), "zstd", asbytes=True)
            head = np.frombuffer(body, np.int32, 2 * pair.shape[1]).reshape(2, -1)
            kinds.append(pair[0]), contents.append(pair[1]), owners.append(np.full(pair.shape[1], i, np.int32))
            sizes.append(head[0]), leads.append(head[1]), bodies.append(np.frombuffer(body, np.uint8, offset=head.nbytes))
        kind, content, owner = np.concatenate(kinds), np.concatenate(contents), np.concatenate(owners)
        size, lead, body = np.concatenate(sizes), np.concatenate(leads), np.concatenate(bodies)
        del bodies
        where = np.cumsum(size, dtype=np.int64) - size
        order = np.lexsort((rank[owner], content, kind))
        sorted_kind = kind[order]
        edges = np.concatenate([[0], np.flatnonzero(sorted_kind[1:] != sorted_kind[:-1]) + 1, [len(order)]])
        told: list[tuple[np.ndarray, np.ndarray]] = []
        # Some thousand pieces at a time, an anchor's always together.
        start = 0
        while start < len(order):
            end = int(edges[np.searchsorted(edges, min(start + BLOCK, len(order)))])
            own = order[start:end]
            told.append(_compared(own, kind, content, rank[owner[own]], size, lead, where, body, length))
            start = end
        own, bits_of = np.concatenate([o for o, _ in told]), np.concatenate([x for _, x in told])
        sort = np.argsort(owner[own], kind="stable")
        own, bits_of = own[sort], bits_of[sort]
        cuts = np.flatnonzero(np.diff(owner[own])) + 1
        parts = [(o, x) for o, x in zip(np.split(own, cuts), np.split(bits_of, cuts), strict=True) if len(o)]
        return pa.table({
            "unit": pa.array([int(unit[owner[o[0]]]) for o, _ in parts], pa.int64()), "bucket": pa.array([0] * len(parts), pa.int32()),
            "hashes": pa.array([content[o].tobytes() for o, _ in parts], pa.binary()),
            "extra": pa.array([x.tobytes() for _, x in parts], pa.binary()),
        })

    def erase(left: pa.Table, replies: pa.Table) -> pa.Table:
        texts = units.unpack(left)
        data, offsets = arrays.text_bytes(texts.column("text"))
        found = pieces(data, offsets, length)
        wide = -(-(places + 1) // 8)
        by_window = pa.array(replies.column("bucket").to_numpy() >> bits > 0)
        earlier, _ = units.answered(replies.filter(by_window), bits, 8)
        replies = replies.filter(pc.invert(by_window))
        contents = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in replies.column("hashes")]) if replies.num_rows else np.zeros(0, np.uint64)
        flags = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, wide) for x in replies.column("extra")]) if replies.num_rows else np.zeros((0, wide), np.uint8)
        sort = np.argsort(contents, kind="stable")
        contents, flags = contents[sort], flags[sort]
        hit = np.flatnonzero(units.among(found.content, contents))
        marks = np.unpackbits(flags[np.searchsorted(contents, found.content[hit])], axis=1)[:, : places + 1] > 0
        line, column = np.nonzero(marks)
        gone = found.anchor[hit][line] - places + column
        hashes = _window_hashes(data, length)
        gone = np.concatenate([gone, _again(hashes, found), np.flatnonzero(units.among(hashes, earlier) & _inside(offsets, length, len(hashes)))])
        flags_of = arrays.covered(np.unique(gone), length, len(data))
        return _result(texts, data, offsets, flags_of)

    sent = units.ask(documents, plan, probes, PROBE)
    collected = units.with_replies(documents, plan, units.reply(sent, repeated), gather, units.REQUEST)
    return units.with_replies(documents, plan, units.reply(collected, compare), erase, RESULT)


def _compared(own: np.ndarray, kind: np.ndarray, content: np.ndarray, unit: np.ndarray, size: np.ndarray, lead: np.ndarray, where: np.ndarray, body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces sorted by anchor, content and unit: those with a window that an earlier unit has, and which windows."""
    places = length - GRAM
    kind, content, lead, size = kind[own], content[own], lead[own].astype(np.int64), size[own].astype(np.int64)
    changed = np.ones(len(own), bool)
    changed[1:] = kind[1:] != kind[:-1]
    fresh = changed.copy()
    fresh[1:] |= content[1:] != content[:-1]
    piece, lone = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    result = np.repeat(unit[lone][:, None], places + 1, axis=1)
    # An anchor with one distinct piece has nothing to compare.
    opens = np.flatnonzero(changed[lone])
    members = np.diff(np.concatenate([opens, [len(lone)]]))
    several = np.flatnonzero(np.repeat(members, members) > 1)
    if len(several):
        at = lone[several]
        text = np.zeros((len(several), places + length), np.uint8)
        low = places - lead[at]
        for i, (source, start, n) in enumerate(zip(where[own[at]].tolist(), low.tolist(), size[at].tolist(), strict=True)):
            text[i, start:start + n] = body[source:source + n]
        result[several] = earliest(kind[at], unit[at], text, low, low + size[at], length)
    column = np.arange(places + 1)
    gone = result[piece] < unit[:, None]
    gone &= (column >= (places - lead)[:, None]) & (column <= (places - lead + size - length)[:, None])
    told = np.flatnonzero(gone.any(axis=1))
    return own[told], np.packbits(gone[told], axis=1)


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    return arrays.windows_hash(arrays.prefix_sums(data.astype(np.uint64) + np.uint64(1)), length)


def _windows(found: Pieces, own: np.ndarray) -> np.ndarray:
    """Starts of all windows of some pieces."""
    sizes = found.last[own] - found.first[own] + 1
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(found.first[own], sizes)


def _inside(offsets: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n windows lie in one text."""
    steps = np.zeros(n + 1, np.int32)
    ends = offsets[1:] - length + 1
    whole = ends > offsets[:-1]
    np.add.at(steps, offsets[:-1][whole], 1)
    np.add.at(steps, ends[whole], -1)
    return np.cumsum(steps[:n]) > 0


def _again(hashes: np.ndarray, found: Pieces) -> np.ndarray:
    """Windows that the unit itself has before."""
    order = np.argsort(found.kind, kind="stable")
    kind = found.kind[order]
    same = np.zeros(len(kind), bool)
    same[1:] = kind[1:] == kind[:-1]
    same[:-1] |= same[1:]
    starts = _windows(found, np.sort(order[same]))
    if not len(starts):
        return np.zeros(0, np.int64)
    own = hashes[starts]
    sort = np.argsort(own, kind="stable")
    later = np.zeros(len(starts), bool)
    later[sort[1:]] = own[sort[1:]] == own[sort[:-1]]
    return starts[later]


def _result(texts: pa.Table, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> pa.Table:
    n_removed, n_spans, kept, removed = [], [], [], []
    sums = np.concatenate([[0], np.cumsum(flags)])
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        count = int(sums[end] - sums[start])
        own = flags[start:end]
        opens, closes = arrays.runs(own) if count else ((), ())
        n_removed.append(count), n_spans.append(len(opens))
        kept.append((data[start:end][~own] if count else data[start:end]).tobytes())
        removed.append([{"start": int(a), "stop": int(b)} for a, b in zip(opens, closes, strict=True)])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({
        "doc_id": texts.column("doc_id"), "n_bytes": pa.array(np.diff(offsets).astype(np.int64)), "n_removed": pa.array(n_removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "removed": pa.array(removed, spans),
    })
