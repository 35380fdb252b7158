"""Sharding: the smallest capacity under which ordered atomic groups fill a number of shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.materialize import materialize

# Atomic groups: texts of equal leading checksum bits, so equal texts are never parted.
GROUP_BITS = 16
# Cells of a shard for numbering its rows.
CELLS = 4096


def smallest_capacity(sizes: Column, shards: int) -> Column:
    """Binary search over capacities; each is checked by filling shards greedily in order."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda sum_, x: sum_ + x)
    largest = F.coalesce(F.array_max(sizes), F.lit(0).cast("long"))
    low = F.greatest(largest, F.ceil(total / shards).cast("long"))
    # No shard needs more than an even share and one group.
    bounds = F.struct(low.alias("low"), (low + largest).alias("high"))

    def needed(capacity: Column) -> Column:
        start = F.struct(F.lit(1).alias("shards"), F.lit(0).cast("long").alias("filled"))
        return F.aggregate(sizes, start, lambda s, x: F.when(s["filled"] + x <= capacity, F.struct(s["shards"].alias("shards"), (s["filled"] + x).alias("filled"))).otherwise(
            F.struct((s["shards"] + 1).alias("shards"), x.alias("filled"))))["shards"]

    def halve(b: Column, _: Column) -> Column:
        def decide(x: Column) -> Column:
            return F.when(needed(x["mid"]) <= shards, F.struct(x["low"].alias("low"), x["mid"].alias("high"))).otherwise(F.struct((x["mid"] + 1).alias("low"), x["high"].alias("high")))
        middle = F.struct(b["low"].alias("low"), b["high"].alias("high"), (b["low"] + F.floor((b["high"] - b["low"]) / 2)).cast("long").alias("mid"))
        return F.when(b["low"] < b["high"], F.element_at(F.transform(F.array(middle), decide), 1)).otherwise(b)

    rounds = F.greatest(F.ceil(F.log2(F.greatest(largest, F.lit(1)) + 1)).cast("int") + 1, F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), rounds), bounds, halve)["high"]


def cut_points(groups: Column, capacity: Column) -> Column:
    """Group numbers with which each shard but the first begins, for (group, bytes) in order."""
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.array().cast("array<long>").alias("cuts"))
    return F.aggregate(groups, start, lambda s, x: F.when(s["filled"] + x["bytes"] <= capacity, F.struct((s["filled"] + x["bytes"]).alias("filled"), s["cuts"].alias("cuts"))).otherwise(
        F.struct(x["bytes"].alias("filled"), F.concat(s["cuts"], F.array(x["group"])).alias("cuts"))))["cuts"]


def shard(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Put documents into shards of nearly equal bytes, equal texts together.

    Texts are ordered by their checksum. Its leading 16 bits make the atomic groups:
    65,536 at most however large the corpus is, so their sizes are one bounded row.
    On that row the smallest capacity is found by binary search (each capacity is
    checked by a greedy fill in order), and the shards are cut there. A group is
    about 1 / 65,536 of the corpus unless one text is more than that by itself, which
    no law that keeps equal texts together can split.

    Slots number a shard's rows without gaps: a shard's rows fall into 4,096 cells by
    a hash of the row, cells are counted (a bounded table), and each cell is numbered
    on its own, so neither a shard nor a hot text is ever ordered in one task.

    Defined cases: null text counts as no bytes (size 1) with checksum 0, like the
    empty text; null ids come last in their cell; repeated rows get slots of their
    own; an empty table gives no rows; with fewer groups than shards some shards stay
    empty. Only doc_id and text have a meaning. Returns doc_id, size, text_crc32, law
    (``bytes``), shard, slot, grown_shard (null under this law).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns))
    sized = materialize(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), row.alias("row")))
    group = F.shiftright("text_crc32", 32 - GROUP_BITS)
    sums = sized.groupBy(group.alias("group")).agg(F.sum("size").alias("bytes"))
    # One row of at most 65,536 groups.
    listed = sums.agg(F.sort_array(F.collect_list(F.struct("group", "bytes"))).alias("groups"))
    sizes = F.transform("groups", lambda x: x["bytes"])
    # Between search and cut the capacity is written down, lest it be searched again for each group.
    found = materialize(listed.select("groups", smallest_capacity(sizes, shards).alias("capacity")))
    cuts = found.select(cut_points(F.col("groups"), F.col("capacity")).alias("cuts")).first()["cuts"]
    # At most shards - 1 numbers.
    at = F.lit(0)
    for cut in cuts:
        at = at + (group >= cut).cast("int")
    placed = sized.withColumn("shard", at).withColumn("cell", F.pmod(F.xxhash64("doc_id", "row"), F.lit(CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    # shards * 4,096 rows at most.
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(F.broadcast(before), ["shard", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
