"""Alert cooldown: the greedy chain of matches at least one cooldown apart.

From each fired alert the chain jumps to the first match that is one cooldown
later. A single key may hold a large share of all matches, so the chain is not
walked along the whole key. Time is cut into blocks, and a block is reduced to
what a chain can see of it: the matches on which it can be entered (its first
cooldown's worth and the one after) and the time from which the next alert may
fire once the chain has left it. Blocks of blocks are reduced the same way, a few
levels up; the top level is walked per key, and the hits are then handed down.

Every step treats many blocks at a time with numpy inside a task; Spark
partitions and sorts the blocks, and no task ever holds more than one block of a
key (plus the small ones beside it).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .materialize import materialize

# Task functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Blocks per block of the next level; three levels of it make the top level
# smaller than the matches by a factor of 64 ** 3 where they are dense.
FAN = 64
LEVELS = 3
# Matches of a key that a task walks at once; a key with more gets a level for each factor FAN.
WALKED = 1 << 16


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no group is split between two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        differs = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy()
        start = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        same_as_held = bool(held) and bool((held[-1][keys].iloc[-1] == frame[keys].iloc[0]).all())
        if start == 0 and same_as_held:
            held.append(frame)
            continue
        done = [*held, frame.iloc[:start]]
        whole = pd.concat(done, ignore_index=True)
        if not whole.empty:
            yield whole
        held = [frame.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    changed = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
    return np.cumsum(changed) - 1


def _jumps(group: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Row of the first match of the same group at or after ``until``; -1 if none."""
    rows = np.arange(len(at))
    left = pd.DataFrame({"g": group, "k": until, "row": rows}).sort_values("k", kind="stable")
    right = pd.DataFrame({"g": group, "k": at, "to": rows}).sort_values("k", kind="stable")
    found = pd.merge_asof(left, right, on="k", by="g", direction="forward")
    jumps = np.full(len(at), -1, dtype="int64")
    jumps[found["row"].to_numpy()] = found["to"].fillna(-1).to_numpy().astype("int64")
    return jumps


def _reduce(keys: list[str], cooldown_us: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, keys):
            group = _group_numbers(frame, keys)
            at, until = frame["at"].to_numpy(), frame["until"].to_numpy()
            jumps = _jumps(group, at, until)
            late = at >= frame["block"].to_numpy() + cooldown_us
            first_late = late & (np.r_[True, ~late[:-1]] | np.r_[True, group[1:] != group[:-1]])
            entries = np.flatnonzero(~late | first_late)
            now = entries.copy()
            while True:
                following = jumps[now]
                go = following >= 0
                if not go.any():
                    break
                now = np.where(go, following, now)
            kept = frame.iloc[entries][[*keys, "at", "seq"]]
            yield kept.assign(until=until[now]).drop(columns="block")

    return run


def _walk(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Walk each group's chain from its marked row and give the rows it hits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, keys):
            marks = frame["entry"].to_numpy()
            frame = frame.assign(g=_group_numbers(frame, keys))
            rows = frame[~marks].reset_index(drop=True)
            if not marks.any() or rows.empty:
                continue
            group, at = rows["g"].to_numpy(), rows["at"].to_numpy()
            jumps = _jumps(group, at, rows["until"].to_numpy())
            starts = frame[marks][["g", "at"]].merge(
                rows[["g", "at"]].assign(row=np.arange(len(rows))), on=["g", "at"])["row"].to_numpy()
            hits, now = [], starts
            while len(now):
                hits.append(now)
                now = jumps[now]
                now = now[now >= 0]
            if hits:
                yield rows.iloc[np.concatenate(hits)][[*[k for k in keys if k != "block"], "at", "seq"]]

    return run


def _block(column: str, length: int):
    return F.col(column) - F.pmod(F.col(column), F.lit(length))


def levels_for(most: int) -> int:
    """Levels of blocks between the matches and the walk, by the most matches that a key has."""
    levels = 0
    while levels < LEVELS and most > WALKED * FAN**levels:
        levels += 1
    return levels


def fired(matches: DataFrame, keys: list[str], at: str, sequence: str, cooldown_us: int,
          fan: int = FAN, levels: int | None = None) -> DataFrame:
    """Sequences of the matches that fire an alert (with their keys and times).

    ``levels`` of blocks are put between the matches and the walk per key: as many as
    the longest key needs, if none are given. The hits are the same for any number.
    """
    if cooldown_us <= 0:
        return matches.select(*keys, F.col(at).alias("at"), F.col(sequence).alias("seq"))
    # Of matches at the same time only the first can fire.
    base = materialize(matches.groupBy(*keys, F.col(at).alias("at")).agg(F.min(sequence).alias("seq")))
    if levels is None:
        levels = levels_for(base.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    item = f"{head}, at bigint, seq bigint, until bigint"
    hit = f"{head}, at bigint, seq bigint"
    grouped = [*keys, "block"]

    items = [base.select(*keys, "at", "seq", (F.col("at") + cooldown_us).alias("until"))]
    lengths = [cooldown_us * fan ** (n + 1) for n in range(levels)]
    for length in lengths:
        placed = items[-1].withColumn("block", _block("at", length))
        items.append(materialize(
            placed.repartition(*grouped).sortWithinPartitions(*grouped, "at")
            .mapInPandas(_reduce(grouped, cooldown_us), item)))

    top = items.pop()
    first = top.groupBy(*keys).agg(F.min("at").alias("at"), F.min_by("seq", "at").alias("seq"))
    entries = first
    for rows, length in [(top, None), *zip(reversed(items), reversed(lengths))]:
        marked = rows.withColumn("entry", F.lit(False)).unionByName(
            entries.select(*keys, "at", "seq", F.lit(0).cast("bigint").alias("until"), F.lit(True).alias("entry")))
        by = list(keys)
        if length is not None:
            marked, by = marked.withColumn("block", _block("at", length)), grouped
        entries = (
            marked.repartition(*by).sortWithinPartitions(*by, "at").mapInPandas(_walk(by), hit))
    return entries
