"""Merkle manifest of a dataset: a tree for every source, a tree over their roots, and a witness for every row.

Rows are appended to the tree of their source in the order of their ids. A task
appends one aligned block of leaves; the roots of all blocks are appended again, block
by block, until each tree has one root. Witnesses are made on the way back.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.blocks import number_rows
from ..operators.materialize import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAN = 16
# Levels of a block, and the leaves that it has at most.
LEVELS = 2
BLOCK = FAN**LEVELS
DIGITS = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LEAVES = "ids array<bigint>, tampered array<string>, digests array<string>"
PACKED = f"tree string, block long, n long, root string, {LEAVES}"
# Place among its run and digests of the others, level by level.
WITNESS = "at array<int>, siblings array<string>, subroot string, root string"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, tampered boolean, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Run:
    """Up to FAN nodes with one parent. While it is open, a later node extends the witnesses of all before it."""

    __slots__ = ("nodes", "up", "at", "above")

    def __init__(self) -> None:
        self.nodes: list[str] = []
        self.up: Run | None = None
        self.at = 0
        self.above: tuple[list[int], list[str]] | None = None

    def siblings(self, at: int) -> str:
        return "".join(self.nodes[:at]) + "".join(self.nodes[at + 1:])

    def path(self) -> tuple[list[int], list[str]]:
        """Witness of the run's parent, the same for all its nodes. The last run is the root alone, and has none."""
        if self.above is None:
            self.above = ([], []) if self.up is None else self.up.witness(self.at)
        return self.above

    def witness(self, at: int) -> tuple[list[int], list[str]]:
        """Place and siblings of a node, level by level; complete once all runs above are closed."""
        if self.up is None:
            return [], []
        places, siblings = self.path()
        return [at, *places], [self.siblings(at), *siblings]


class Appends:
    """A tree that grows by appending: one open run a level. ``add`` gives the partial witness of what it appends."""

    def __init__(self) -> None:
        self.open: list[Run] = []

    def add(self, node: str, level: int = 0) -> tuple[Run, int]:
        if level == len(self.open):
            self.open.append(Run())
        run = self.open[level]
        run.nodes.append(node)
        at = len(run.nodes) - 1
        if len(run.nodes) == FAN:
            self._close(level)
        return run, at

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run()
        run.up, run.at = self.add(digest("".join(run.nodes)), level + 1)

    def finish(self, levels: int) -> str:
        """Close what is open below that level; the one node there is the root."""
        for level in range(levels):
            if self.open[level].nodes:
                self._close(level)
        return self.open[levels].nodes[0]


def _grown(nodes: list[str], levels: int) -> tuple[list[tuple[Run, int]], str]:
    tree = Appends()
    held = [tree.add(x) for x in nodes]
    return held, tree.finish(levels)


def _levels(n: int) -> int:
    """Levels of a block in a tree of n nodes: a block of many has all, a tree that is one block ends at its root."""
    levels = 0
    while levels < LEVELS and FAN**levels < n:
        levels += 1
    return levels


def _pack(nodes: pa.Table) -> pa.Table:
    """One block: its nodes in order, and its root."""
    nodes = nodes.sort_by("pos")
    n = nodes.column("n")[0].as_py()
    digests = nodes.column("digest").to_pylist()
    root = _grown(digests, _levels(n))[1]
    return pa.table({
        "tree": nodes.column("tree").slice(0, 1), "block": pa.array([nodes.column("pos")[0].as_py() // BLOCK], pa.int64()), "n": pa.array([n], pa.int64()), "root": pa.array([root]),
        "ids": pa.array([nodes.column("doc_id").to_pylist()], pa.list_(pa.int64())), "tampered": pa.array([nodes.column("tampered").to_pylist()], pa.list_(pa.string())),
        "digests": pa.array([digests], pa.list_(pa.string()))})


def _grow(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of every round; nodes: tree, n (of the tree), pos, digest, doc_id, tampered. Roots of blocks are the next round's nodes."""
    rounds = []
    while True:
        block = F.floor(F.col("pos") / BLOCK).alias("block")
        packed = materialize(nodes.groupBy("tree", block).applyInArrow(_pack, PACKED))
        rounds.append(packed)
        above = packed.where(F.col("n") > BLOCK)
        if above.isEmpty():
            return rounds
        nodes = above.select(
            "tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("root").alias("digest"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered"))


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """tree and root of every tree: the root of its only block in the round where it has one."""
    out = None
    for packed in rounds:
        found = packed.where(F.col("n") <= BLOCK).select("tree", "root")
        out = found if out is None else out.unionByName(found)
    return out


def _witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Witnesses of the nodes of blocks, each of which comes with its own: tree, pos, and WITNESS."""
    for batch in batches:
        for row in batch.to_pylist():
            held, _ = _grown(row["digests"], _levels(row["n"]))
            base, ats, siblings = row["block"] * BLOCK, [], []
            for run, at in held:
                places, beside = run.witness(at)
                ats.append(places + row["at"])
                siblings.append(beside + row["siblings"])
            n = len(held)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["tree"]] * n, pa.string()), pa.array(range(base, base + n), pa.int64()), pa.array(ats, pa.list_(pa.int32())), pa.array(siblings, pa.list_(pa.string())),
                pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string())], ["tree", "pos", "at", "siblings", "subroot", "root"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every leaf of a block gets: hash of its witness, and the root that the leaf (tampered, if it is) folds to."""
    for batch in batches:
        for row in batch.to_pylist():
            held, _ = _grown(row["digests"], _levels(row["n"]))
            proofs, folded = [], []
            tail = "".join(row["siblings"])
            upper = list(zip(row["at"], row["siblings"], strict=True))
            for (run, at), leaf, other in zip(held, row["digests"], row["tampered"], strict=True):
                places, beside = run.witness(at)
                proofs.append(digest("".join(beside) + tail))
                node = leaf if other is None else other
                for place, others in [*zip(places, beside, strict=True), *upper]:
                    node = digest(others[:place * DIGITS] + node + others[place * DIGITS:])
                folded.append(node)
            n = len(held)
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], pa.int64()), pa.array(row["digests"]), pa.array([row["subroot"]] * n), pa.array([row["top"]] * n), pa.array(proofs),
                pa.array([x is not None for x in row["tampered"]]), pa.array(folded), pa.array([x == row["top"] for x in folded])],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "tampered", "folded_root", "verified"])


def _descend(rounds: list[DataFrame], tops: DataFrame) -> Iterator[DataFrame]:
    """Blocks of each round, the last one first, with the witness of each block; tops: WITNESS of every tree."""
    below = None
    for packed in reversed(rounds):
        held = packed.withColumnRenamed("root", "own")
        placed = held.where(F.col("n") <= BLOCK).join(tops, "tree")
        if below is not None:
            placed = placed.unionByName(held.where(F.col("n") > BLOCK).join(below.withColumnRenamed("pos", "block"), ["tree", "block"]))
        yield placed
        if packed is not rounds[0]:
            below = materialize(placed.select("tree", "block", "n", "digests", "at", "siblings", "subroot", "root").mapInArrow(_witnesses, f"tree string, pos long, {WITNESS}"))


def _numbered(leaves: DataFrame) -> DataFrame:
    """Add pos (from 0, in its tree) and n (rows of the tree) in the order of ids, by range; no key is brought into one task."""
    order = ["tree", F.col("doc_id").asc_nulls_first(), "digest", "tie"]
    ordered = materialize(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    parted = ordered.withColumn("part", F.shiftrightunsigned("place", 33))
    # One row for each tree in each partition.
    counts = parted.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("low"))
    whole = Window.partitionBy("tree")
    offsets = counts.select("part", "tree", "low", F.sum("rows").over(whole).alias("n"), (F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).alias("before"))
    return parted.join(offsets, ["part", "tree"]).select("tree", "n", (F.col("place") - F.col("low") + F.col("before")).alias("pos"), "digest", "doc_id", "tampered")


def leaf_of(text: Column) -> Column:
    """Digest of a row: each field as its number of bytes, a colon and the value; a null is a dash."""
    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(field(text if name == "text" else F.col(name)) for name in FIELDS)), 256)


def manifest(documents: DataFrame, tamper_every: int = 5) -> DataFrame:
    """Leaf, subroot, root and witness of every row, and whether the row as it is now still folds to the root.

    A row's leaf is the SHA-256 of doc_id, source, lang, n_chars and text. Every 16
    consecutive leaves of a source, in the order of ids, have a parent, and so on up to
    the source's subroot; subroots in the order of sources are the leaves of the tree
    that has the root. The witness of a row is what stands beside its path, and
    ``proof_sha256`` its hash. For rows whose CRC-32 of the decimal doc_id is divisible
    by ``tamper_every`` the folded leaf is that of the text in lower case (A-Z), which
    is what an altered row looks like.

    Appending goes on wherever the rows are: rows are numbered by range, 256 leaves (an
    aligned block) are appended in one task, and the roots of blocks are further
    appends, so a source with a third of all rows is as many blocks as it needs. A
    node's witness begins with what stands left of it when it is appended, and grows
    with every later node of its run; runs share theirs with all rows below. Witnesses
    of blocks are handed down, so no row's witness is written anywhere but as its hash.

    Defined cases: a null field is a dash (an empty one is not); null sources are one
    source, before all others; null ids come first in their source and are never
    tampered with; rows of one id follow by their leaf, and repeated rows take adjacent
    places; other columns have no part in it; an empty table gives no rows.
    Returns doc_id, leaf, subroot, root, proof_sha256, tampered, folded_root, verified.
    """
    lowered = F.translate(F.col("text").cast("string"), CAPITALS, CAPITALS.lower())
    tamper = F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0
    leaves = materialize(documents.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(F.col("text")).alias("digest"), F.when(tamper, leaf_of(lowered)).alias("tampered"), F.monotonically_increasing_id().alias("tie")))
    rounds = _grow(_numbered(leaves))
    subroots = materialize(number_rows(_roots(rounds), ["tree"], "place"))
    none = [F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("siblings")]
    n = subroots.count()
    if not n:
        return documents.sparkSession.createDataFrame([], RESULT)
    top = _grow(subroots.select(
        F.lit("").alias("tree"), F.lit(n).cast("long").alias("n"), (F.col("place") - 1).alias("pos"), F.col("root").alias("digest"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered")))
    placed = list(_descend(top, _roots(top).select("tree", *none, F.lit("").alias("subroot"), "root")))[-1]
    beside = placed.select("tree", "block", "n", "digests", "at", "siblings", "subroot", "root").mapInArrow(_witnesses, f"tree string, pos long, {WITNESS}")
    tops = materialize(subroots.select("tree", F.col("root").alias("subroot"), (F.col("place") - 1).alias("pos")).join(beside.drop("tree", "subroot"), "pos").drop("pos"))
    placed = list(_descend(rounds, tops))[-1]
    return placed.select("n", "digests", "ids", "tampered", "at", "siblings", "subroot", F.col("root").alias("top")).mapInArrow(_proofs, RESULT)


def answer(levels: int = 7, root_levels: int = 5) -> str:
    """The same in DuckDB SQL, level by level; for up to 16 ** levels rows of a source."""
    def field(value: str) -> str:
        return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if name == "text" else name) for name in FIELDS) + ")"

    def climb(nodes: str, rows: str, levels: int) -> list[str]:
        """nodes: tree, pos, n, digest; rows: key, tree, pos, n, node, proof."""
        out = [f"{nodes}0 as (select * from {nodes})", f"{rows}0 as (select * from {rows})"]
        for k in range(levels):
            out += [
                f"{nodes}{k + 1} as (select tree, pos // 16 as pos, (n + 15) // 16 as n, sha256(string_agg(digest, '' order by pos)) as digest from {nodes}{k} where n > 1 group by all"
                f" union all select * from {nodes}{k} where n = 1)",
                f"{rows}{k + 1} as (select r.key, r.tree, r.pos // 16 as pos, (r.n + 15) // 16 as n, sha256(string_agg(case when s.pos = r.pos then r.node else s.digest end, '' order by s.pos)) as node,"
                f" r.proof || coalesce(string_agg(s.digest, '' order by s.pos) filter (where s.pos <> r.pos), '') as proof from {rows}{k} r join {nodes}{k} s on s.tree = r.tree and s.pos // 16 = r.pos // 16"
                f" where r.n > 1 group by r.key, r.tree, r.pos, r.n, r.node, r.proof union all select * from {rows}{k} where n = 1)",
            ]
        return out

    capitals = f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"
    crc = ("xor(list_reduce([ascii(x) for x in string_split(cast(doc_id as varchar), '')], lambda c, b: "
           "list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(c, cast(b as bigint))), 4294967295), 4294967295)")
    steps = [
        f"docs as (select row_number() over () as key, doc_id, coalesce('=' || source, '-') as tree, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {leaf(capitals)} end as other from documents)",
        "nodes as (select tree, row_number() over (partition by tree order by doc_id nulls first, leaf, key) - 1 as pos, count(*) over (partition by tree) as n, leaf as digest from docs)",
        "paths as (select key, tree, row_number() over (partition by tree order by doc_id nulls first, leaf, key) - 1 as pos, count(*) over (partition by tree) as n, coalesce(other, leaf) as node, '' as proof from docs)",
        *climb("nodes", "paths", levels),
        f"tops as (select '' as tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n, digest, tree as below from nodes{levels})",
        "roots as (select tree, pos, n, digest from tops)",
        f"sides as (select p.key, '' as tree, t.pos, t.n, p.node, p.proof from paths{levels} p join tops t on t.below = p.tree)",
        *climb("roots", "sides", root_levels),
    ]
    return (
        f"with {', '.join(steps)} select d.doc_id, d.leaf, t.digest as subroot, r.digest as root, sha256(s.proof) as proof_sha256, d.other is not null as tampered, s.node as folded_root, s.node = r.digest as verified"
        f" from docs d join tops t on t.below = d.tree join sides{root_levels} s on s.key = d.key cross join roots{root_levels} r")
