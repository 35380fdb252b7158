"""Mixing sources to target weights: pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.blocks import number_rows
from ..operators.materialize import materialize
from .rows import row_key, take_rows

GAPS = r"[\x20\x09-\x0D]"
# Documents folded by one group of the tree.
FAN = 64
ITEM = "struct<doc_id: bigint, row: bigint, size: bigint, chance: double>"


def word_count(text: str | Column) -> Column:
    """Words of a text: runs of anything but the space and the controls from tab to return; null has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{GAPS}+|{GAPS}+\z", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"{GAPS}+"))).cast("long")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """source, source_size, target: shares by weight, none above ``limit`` times the source's size.

    What a full source can't take is shared among the others by weight, until none is
    above: with the sources that are full left out, the share of a unit of weight
    only grows, so each round fills more sources or ends.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(sums, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).withColumn("most", limit * F.col("source_size")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        is_full = F.col("most") <= F.lit(share) * F.col("weight")
        row = ranked.agg(F.sum(is_full.cast("long")).alias("n"), F.sum(F.when(is_full, F.col("most"))).alias("most"), F.sum(F.when(~is_full, F.col("weight"))).alias("weight")).first()
        if row["weight"] is None or row["n"] == full:
            break
        full, share = row["n"], (total - (row["most"] or 0.0)) / row["weight"]
    return ranked.select("source", "source_size", F.least(F.col("most"), F.lit(share) * F.col("weight")).alias("target"))


def _step(held: Column, item: Column) -> Column:
    """Move mass between the carried document and the next until one is integral: state with one more decided."""
    def settle(x: Column) -> Column:
        a, b = x["a"], x["b"]
        room, give = (1 - a["chance"]) * a["size"], b["chance"] * b["size"]
        drop, take = a["chance"] * a["size"], (1 - b["chance"]) * b["size"]
        up, down = F.least(room, give), F.least(drop, take)
        # Up with a chance of down / (up + down): the expected mass of both stays.
        goes_up = _uniform(a["doc_id"], a["row"], b["doc_id"], b["row"]) * (up + down) < down
        def with_chance(doc: Column, chance: Column) -> Column:
            return F.struct(doc["doc_id"].alias("doc_id"), doc["row"].alias("row"), doc["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance)).alias("chance"))
        first_done = F.when(goes_up, room <= give).otherwise(drop <= take)
        settled = F.when(goes_up, F.lit(1.0)).otherwise(F.lit(0.0))
        decided = F.when(first_done, with_chance(a, settled)).otherwise(with_chance(b, 1 - settled))
        left = F.when(first_done, with_chance(b, F.when(goes_up, (give - room) / b["size"]).otherwise(b["chance"] + drop / b["size"]))).otherwise(
            with_chance(a, F.when(goes_up, a["chance"] + give / a["size"]).otherwise((drop - take) / a["size"])))
        return F.struct(left.alias("left"), F.concat(x["done"], F.array(decided)).alias("done"))
    # One evaluation of each item: a lambda over an array of one binds it.
    return F.element_at(F.transform(F.array(F.struct(held["left"].alias("a"), item.alias("b"), held["done"].alias("done"))), settle), 1)


def _fold(items: Column) -> Column:
    """Decided documents of a group and the one that is left, for a sorted list of items."""
    start = F.struct(F.element_at(items, 1).alias("left"), F.array().cast(f"array<{ITEM}>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, _step)


def mix(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """How often each document is taken so that sources meet their shares of all words.

    A source's copies per document are ``target / source_size``: everyone gets the
    whole part, and the rest is a chance that pivotal rounding makes 0 or 1. Two
    documents at a time, mass (words) moves from one to the other, in a random
    direction that keeps both expectations, until one is integral; the other goes on
    to meet the next. Groups of about 64 documents of a source fold on their own,
    and what each leaves over meets in groups of the next level of the tree, until a
    source has one left; that one takes the nearer integer. A source's words
    therefore miss the target by half of one document at most.

    Random numbers are hashes of the two documents, so reruns agree, however rows are
    dealt. Sources are in the order of their code points, null last (a source of its
    own), with ``weights`` in turn.

    Defined cases: null, empty and blank texts have size 0 and are taken 0 words,
    with the whole part of copies; repeated rows are documents of their own; rows are
    told apart by doc_id and a hash of all columns; null ids are fine; no words at
    all give targets of 0; an empty table gives no rows. Only doc_id, source and text
    have a meaning. Returns doc_id, row (hash of the row), size, source_size, target,
    copies, taken.
    """
    held = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(documents).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = materialize(held)
    sources = source_targets(sized, weights, limit)
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = materialize(sources.alias("s").join(counts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).select("s.*", "c.n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = joined.select("d.*", "source_size", "target", "n", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("chance"))

    rounded = (F.col("size") > 0) & (F.col("chance") > 0)
    most = sources.agg(F.max("n")).first()[0] or 0
    kept = ["source_size", "target", "whole"]
    here = placed.where(rounded).select("source", "n", *kept, F.struct("doc_id", "row", "size", "chance").alias("item"))
    results = [placed.where(~rounded).select("doc_id", "row", "size", *kept, F.lit(0.0).alias("chance"))]
    level, groups = 0, FAN
    while True:
        number = F.greatest(F.ceil(F.col("n") / groups), F.lit(1))
        bin_of = F.pmod(F.xxhash64("item.doc_id", "item.row", F.lit(level)), number)
        folded = here.groupBy("source", "n", *kept, bin_of.alias("bin")).agg(F.sort_array(F.collect_list("item")).alias("items"))
        step = materialize(folded.select("source", "n", *kept, _fold(F.col("items")).alias("state")))
        results.append(step.select(*kept, F.explode("state.done").alias("item")).select("item.doc_id", "item.row", "item.size", *kept, "item.chance"))
        here = step.select("source", "n", *kept, F.col("state.left").alias("item"))
        if most <= groups:
            break
        level, groups = level + 1, groups * FAN
    results.append(here.select("item.doc_id", "item.row", "item.size", *kept, F.round("item.chance").alias("chance")))
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    copies = (F.col("whole") + F.col("chance")).cast("long")
    return every.select("doc_id", "row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def repeat_documents(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as they are taken, with their own columns.

    Rows meet their copies by doc_id and row hash; of repeated rows each gets one of
    the numbers decided for them.
    """
    return take_rows(documents, mixed.groupBy("doc_id", "row").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")))
