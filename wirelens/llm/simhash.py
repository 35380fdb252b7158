"""SimHash near-dedup: a trie self-join over fingerprints, and connected components."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.materialize import materialize
from .rows import row_key, take_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
BITS = 64
# Parts into which the nodes of a component are dealt when they learn its name.
PARTS = 32
# Node pairs that a task expands at a time.
FRONT = 1 << 18


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of each bit over the hashes of all word shingles of a lower-case text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, row (hash of the row) and fp (the fingerprint's bits as a signed long) of every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.array([fingerprint(x.as_py() or b"", shingle) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "row", "fp"])

    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("row"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, row long, fp long")


def _parts(errors: int) -> list[tuple[int, ...]]:
    """Choices of error-free parts: of errors + 2 parts, two are alike in any linked pair."""
    return list(combinations(range(errors + 2), 2))


def _edges(errors: int) -> list[int]:
    return [round(BITS * i / (errors + 2)) for i in range(errors + 3)]


def trie_links(values: np.ndarray, group: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs, enough to connect all that are linked within a group.

    values are sorted within their group. A node of the trie is a range of them that
    shares leading bits. All groups' roots start paired with themselves; each step
    looks at the first bit in which a node's values differ. A pair of nodes carries
    the differing bits so far and is dropped once they exceed the budget, or once
    both sides are connected already. A node whose values differ in no more bits
    than the budget allows is one cluster: its members are chained, not paired.
    """
    n = len(values)
    opens = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    closes = np.concatenate([opens[1:], [n]]).astype(np.int64)
    several = closes - opens > 1
    root = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == root[up]).all():
                return up
            root[x] = root[up]

    found: list[tuple[np.ndarray, np.ndarray]] = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        """Connect pairs; of those that connect the same two clusters one is kept."""
        while len(a):
            ra, rb = roots(a), roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, once = np.unique(high, return_index=True)
            root[high[once]] = low[once]
            found.append((a[once], b[once]))

    stack = [(opens[several], closes[several], opens[several], closes[several], np.zeros(int(several.sum()), np.int64))]
    while stack:
        al, ah, bl, bh, _ = front = stack.pop()
        if len(al) > FRONT:
            half = len(al) // 2
            stack += [tuple(x[half:] for x in front), tuple(x[:half] for x in front)]
            continue
        # The leading bits that all values of both nodes share are decided; find how long they are.
        ends = np.stack([values[al], values[ah - 1], values[bl], values[bh - 1]])
        spread = (ends[0] ^ ends[1]) | (ends[2] ^ ends[3])
        leaf = spread == 0
        differ = np.bitwise_count(ends[0] ^ ends[2]).astype(np.int64)
        ok = leaf & (differ <= errors)
        link(al[ok], bl[ok])
        al, ah, bl, bh, spread = al[~leaf], ah[~leaf], bl[~leaf], bh[~leaf], spread[~leaf]
        if not len(al):
            continue
        # Bits above the first one in which a node splits are the node's own: their differences are final.
        top = np.uint64(63) - _leading_zeros(spread)
        below = (np.uint64(1) << top) | ((np.uint64(1) << top) - np.uint64(1))
        decided = np.bitwise_count((values[al] ^ values[bl]) & ~below).astype(np.int64)
        same = (al == bl) & (ah == bh)
        keep = decided <= errors
        dense = keep & same & (np.int64(1) + top.astype(np.int64) <= errors)
        for a, b in zip(al[dense].tolist(), ah[dense].tolist(), strict=True):
            link(np.arange(a, b - 1), np.arange(a + 1, b))
        keep &= ~dense
        al, ah, bl, bh, top, same = al[keep], ah[keep], bl[keep], bh[keep], top[keep], same[keep]
        am, bm = _split(values, al, ah, top), _split(values, bl, bh, top)
        parts = [(al, am, bl, bm, np.ones(len(al), bool)), (am, ah, bm, bh, np.ones(len(al), bool)), (al, am, bm, bh, np.ones(len(al), bool)), (am, ah, bl, bm, ~same)]
        cut = [np.concatenate(x) for x in zip(*parts, strict=True)]
        full = cut[4] & (cut[1] > cut[0]) & (cut[3] > cut[2]) & ~((cut[0] == cut[2]) & (cut[1] - cut[0] == 1))
        nxt = [x[full] for x in cut[:4]]
        if len(nxt[0]):
            # Two single values that are connected already need no look.
            lone = (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1)
            skip = np.zeros(len(lone), bool)
            skip[lone] = roots(nxt[0][lone]) == roots(nxt[2][lone])
            nxt = [x[~skip] for x in nxt]
        stack.append((*nxt, np.zeros(len(nxt[0]), np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return np.uint64(64) - np.bitwise_count(x).astype(np.uint64)


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First position in each range whose value has the bit; all higher bits are equal in a range."""
    low, high = low.copy(), high.copy()
    while True:
        live = low < high
        if not live.any():
            return low
        mid = (low + high) // 2
        has = (values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1) > 0
        high = np.where(live & has, mid, high)
        low = np.where(live & ~has, mid + 1, low)


def _turned(values: np.ndarray, shift: int) -> np.ndarray:
    """Bits rotated to the left."""
    if not shift:
        return values
    return (values << np.uint64(shift)) | (values >> np.uint64(BITS - shift))


def links(distinct: DataFrame, errors: int = 4) -> DataFrame:
    """Links between distinct fingerprints (column fp), enough to connect all within the budget.

    Two fingerprints with up to ``errors`` differing bits agree in two of
    ``errors + 2`` parts at least. For each choice of two parts the fingerprints are
    dealt by these parts, and every group is joined with itself over its trie.
    """
    edges, choices = _edges(errors), _parts(errors)

    def key(choice: int, first: int, second: int):
        bits = [F.expr(f"shiftrightunsigned(fp, {BITS - edges[p + 1]}) & {(1 << (edges[p + 1] - edges[p])) - 1}L") for p in (first, second)]
        return F.struct(F.lit(choice).alias("choice"), (bits[0] * (1 << (edges[second + 1] - edges[second])) + bits[1]).alias("part"))

    dealt = distinct.select("fp", F.explode(F.array(*(key(i, *pair) for i, pair in enumerate(choices)))).alias("at")).select("at.choice", "at.part", "fp")
    # Enough bins that a bin's groups are small together; the group of a key is whole in its bin.
    binned = dealt.repartition("choice", "part").sortWithinPartitions("choice", "part", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 18:
                table, held = _whole(pa.Table.from_batches(held))
                rows = sum(x.num_rows for x in held)
                yield from _joined(table, errors)
        if held:
            yield from _joined(pa.Table.from_batches(held), errors)

    return binned.mapInArrow(join, "a long, b long")


def _whole(table: pa.Table) -> tuple[pa.Table, list[pa.RecordBatch]]:
    """The complete groups at the front of sorted rows, and the rest."""
    choice, part = table.column("choice").to_numpy(), table.column("part").to_numpy()
    last = np.flatnonzero((choice != choice[-1]) | (part != part[-1]))
    edge = int(last[-1]) + 1 if len(last) else 0
    return table.slice(0, edge), table.slice(edge).to_batches()


def _joined(table: pa.Table, errors: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    choice, part, fp = (table.column(c).to_numpy() for c in ("choice", "part", "fp"))
    values = fp.view(np.uint64)
    group = np.cumsum(np.concatenate([[False], (choice[1:] != choice[:-1]) | (part[1:] != part[:-1])]))
    order = np.lexsort((values, group))
    a, b = trie_links(values[order], group[order], errors)
    a, b = order[a], order[b]
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[a], fp[b])), pa.array(np.maximum(fp[a], fp[b]))], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the links: alike in two rounds only when nothing moves any more."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of a link can reach, roots left out.

    Rounds of hooking and shortening on tables: each node points to the least
    neighbour's root, then follows pointers. A round's table is written once to the
    shared folder; their number grows with the logarithm of the longest path.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while True:
        # Every node links its larger neighbours, and itself, to the least node around it.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(up, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        following = materialize(small)
        if (state := _state(following)) == before:
            return following.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = following


def near_duplicates(documents: DataFrame, shingle: int = 4, errors: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints: the lower-case (A-Z) words of the whole text, shingles of
    ``shingle`` words, repeats counted, XXH64 with seed 42; a bit is set where over
    half of the hashes have it. Fingerprints with up to ``errors`` differing bits
    are linked; component_id is the smallest doc_id that can be reached.

    Rows with one fingerprint are one node, so copies cost nothing in the join, and
    only as many links leave a task as connect what is linked there.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked
    like any other; a text with fewer words than a shingle is one shingle; a row
    without doc_id keeps its fingerprint, links others, and is not a component's
    name unless none has an id (then component_id is null); repeated rows give
    repeated results; only ``doc_id`` and ``text`` are read; an empty table gives
    no rows.
    """
    return _grouped(documents, shingle, errors).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(documents: DataFrame, shingle: int, errors: int) -> DataFrame:
    """doc_id, row, fp, root (the component's name among fingerprints) and component_id of every row."""
    found = materialize(fingerprints(documents, shingle))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(nodes.select("fp"), errors))
    part = F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int").alias("part")
    rooted = nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), part)
    # One component may hold a large share of all nodes: its name goes to each of its parts that has nodes. These
    # are rows that are there, at most as many as nodes; Spark would count those of an explode as one a component.
    pieces = rooted.groupBy("root", "part").agg(F.min("least").alias("least"))
    names = pieces.select("root", "part", F.min("least").over(Window.partitionBy("root")).alias("component_id"))
    named = rooted.join(names, ["root", "part"]).select(F.col("fp").alias("node"), "root", "component_id")
    return found.join(named, F.col("fp") == F.col("node")).select("doc_id", "row", "fp", "root", "component_id")


def keep_one(documents: DataFrame, shingle: int = 4, errors: int = 4) -> DataFrame:
    """One document of each component of ``near_duplicates``, all columns as they are: that of the smallest doc_id.

    Rows without an id stand for a component only if it has no other; of rows with one
    id the one with the smaller hash stays, and of repeated rows one.
    """
    rows = _grouped(documents, shingle, errors).groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("rows"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "rows")).alias("best"))
    return take_rows(documents, best.select("best.doc_id", "best.row", F.lit(1).cast("long").alias("copies"), "best.rows"))
