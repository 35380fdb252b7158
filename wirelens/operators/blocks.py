"""Ordered scans over keys that may be very long.

A window partitioned by connection puts every row of that connection into one
task. One connection may hold a third of all rows, so the scans here cut each
key into blocks of its order column, fold every block to one row, scan those few
rows, and hand each block the state it starts from:

    rows  --group by (key, block)-->  one row per block  --window over key-->
    carry-in per block  --join on (key, block)-->  rows with carry-in,
    then windows over (key, block) only.

The rows themselves are shuffled once, by (key, block); the join and every
window over the block share that partitioning. The fold keeps to bigint
aggregates wherever it can, so it runs as a hash aggregate with map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .materialize import materialize

BLOCK = "_block"


def with_block(df: DataFrame, order: str | Column, size: int) -> DataFrame:
    """Number the blocks of ``size`` order units: no block holds more distinct orders."""
    value = F.col(order) if isinstance(order, str) else order
    return df.withColumn(BLOCK, value - F.pmod(value, F.lit(size)))


def fitting_width(df: DataFrame, keys: Sequence[str], order: str, width: int, most: int) -> int:
    """Largest width, halved from ``width``, at which no block of a key holds more than ``most`` rows.

    Order values that repeat (equal times) cannot be told apart by any width, so
    the search ends at one unit. Each try is one aggregation over two narrow
    columns, combined on the map side; usually the first one settles it.
    """
    while width > 1:
        fullest = with_block(df.select(*keys, order), order, width).groupBy(*keys, BLOCK).count().agg(F.max("count")).head()[0] or 0
        if fullest <= most:
            break
        # Rows spread evenly would fit at this fraction; go at least to the half.
        width = max(1, min(width // 2, width * most // fullest))
    return width


def earlier_blocks(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def later_blocks(keys: Sequence[str]) -> WindowSpec:
    # Runs backwards: a frame that ends at the last row is recomputed per row.
    return Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)


def within(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """Rows of one block up to the current one."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """Rows of one block before the current one."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def carry_in(
    df: DataFrame,
    keys: Sequence[str],
    fold: Mapping[str, Column],
    carry: Mapping[str, Callable[[], Column]],
    source: DataFrame | None = None,
) -> DataFrame:
    """Join to each row the state its block starts from.

    ``fold`` aggregates one block of ``source`` (``df`` by default; a narrower
    frame where only some rows matter); ``carry`` scans those block rows.
    Blocks without a fold row carry nulls.
    """
    blocks = (source if source is not None else df).groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in fold.items()])
    carried = blocks.select(*keys, BLOCK, *[make().alias(n) for n, make in carry.items()])
    return df.join(carried, [*keys, BLOCK], "left")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], size: int) -> DataFrame:
    """Add running sums (current row included) of ``values`` along ``order`` for each key."""
    staged = with_block(df.withColumns({f"_v_{n}": c.cast("bigint") for n, c in values.items()}), order, size)
    scan = earlier_blocks(keys)
    carried = carry_in(
        staged, keys,
        {f"_s_{n}": F.sum(f"_v_{n}") for n in values},
        {f"_c_{n}": (lambda n=n: F.sum(f"_s_{n}").over(scan)) for n in values},
    )
    here = within(keys, order)
    summed = carried.withColumns({
        n: F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.sum(f"_v_{n}").over(here) for n in values
    })
    return summed.drop(BLOCK, *[f"_{p}_{n}" for n in values for p in "vc"])


def last_before(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[Column, Column]],
                size: int) -> DataFrame:
    """As-of lookup: add, for each name, the value of the latest earlier row that qualifies.

    ``values`` maps a name to (condition, value). One fold serves all names.
    """
    staged = with_block(df, order, size)
    picked = {n: F.when(condition, F.struct(value.alias("v"))) for n, (condition, value) in values.items()}
    scan, here = earlier_blocks(keys), before(keys, order)
    carried = carry_in(
        staged, keys,
        {f"_f_{n}": F.max_by(pick, F.when(pick.isNotNull(), F.col(order))) for n, pick in picked.items()},
        {f"_c_{n}": (lambda n=n: F.last(f"_f_{n}", ignorenulls=True).over(scan)) for n in values},
    )
    found = {
        n: F.coalesce(F.last(pick, ignorenulls=True).over(here), F.col(f"_c_{n}"))["v"] for n, pick in picked.items()}
    return carried.withColumns(found).drop(BLOCK, *[f"_c_{n}" for n in values])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], limit: int, name: str = "_rank") -> DataFrame:
    """The first ``limit`` rows of each key, ranked.

    The rank filter is applied by every map task before its rows are shuffled,
    so a hot key sends ``limit`` rows per map task and no more.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Number rows 1, 2, ... along a unique ``order`` without bringing them into one task.

    Rows are range-partitioned and sorted; the partition sizes (one number per
    partition) give each partition its offset. The sorted rows are materialized
    first, so a re-run task cannot disagree with the offsets.
    """
    ordered = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    # The upper bits of the id are the partition, the lower 33 the position in it.
    part = F.shiftrightunsigned("_place", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    # One row per partition: never more rows than the shuffle has partitions.
    placed = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    position = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, F.col("_offset") + position + 1).drop("_part", "_place", "_offset")
