"""Tables that a stream keeps between its batches: an append-only log by time, and state by key.

Both write what is new and nothing else. A batch that is tried again writes the same
folders again; folders that no later batch can need are removed once the batch that
no longer needed them has been followed by another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.materialize import remove

_PARTS = "batch bigint, bucket bigint, dropped bigint"


class Tables:
    """Tables of one stream in one folder, each with a folder for every batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def write(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(self.folder(name, batch))

    def read(self, name: str, batches: Sequence[int], schema: object) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.folder(name, b) for b in batches))

    def before(self, name: str, batch: int, schema: object) -> DataFrame:
        """The table as the batch before left it; empty for the first batch."""
        return self.read(name, [batch - 1] if batch > 0 else [], schema)

    def all(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*").drop("batch")

    def drop(self, name: str, batch: int) -> None:
        remove(self.spark, self.folder(name, batch))


@dataclass(frozen=True)
class _Parts:
    """Folders of a log that may still be read: (batch, bucket)."""

    live: list[tuple[int, int]]


class TimeLog:
    """Rows by the time bucket they lie in, written once.

    A batch appends its rows, split by bucket; which folders it wrote is its entry in
    the list of parts, a few numbers that go from batch to batch. A reader names the
    times it wants and gets the folders of those buckets only. ``forget`` takes the
    buckets before a time off the list; their folders are removed two batches later,
    when no batch that reads them can be tried again.
    """

    def __init__(self, tables: Tables, name: str, at: str, bucket_us: int) -> None:
        self.tables, self.name, self.at, self.bucket_us = tables, name, at, bucket_us

    def bucket(self, time: int) -> int:
        return time // self.bucket_us

    def start(self, bucket: int) -> int:
        return bucket * self.bucket_us

    def _list(self, batch: int) -> list[tuple[int, int, int | None]]:
        rows = self.tables.before(f"{self.name}_parts", batch, _PARTS).collect()
        return [(r["batch"], r["bucket"], r["dropped"]) for r in rows]

    def append(self, rows: DataFrame, batch: int) -> tuple[int | None, _Parts]:
        """Write a batch's rows; gives the newest time in them and the parts that are there now."""
        path = self.tables.folder(self.name, batch)
        rows = rows.where(F.col(self.at).isNotNull())
        where = ((F.col(self.at) - F.pmod(F.col(self.at), F.lit(self.bucket_us))) / self.bucket_us).cast("bigint")
        rows.withColumn("_bucket", where).write.mode("overwrite").partitionBy("_bucket").parquet(path)
        held = self.tables.spark.read.schema(f"{self.at} bigint, _bucket bigint").parquet(path)
        found = held.groupBy("_bucket").agg(F.max(self.at).alias("newest")).collect()
        known = [(b, k) for b, k, dropped in self._list(batch) if dropped is None]
        return max((r["newest"] for r in found), default=None), _Parts(known + [(batch, r["_bucket"]) for r in found])

    def parts(self, batch: int) -> _Parts:
        """What is there before a batch, for one that appends nothing."""
        return _Parts([(b, k) for b, k, dropped in self._list(batch) if dropped is None])

    def read(self, parts: _Parts, after: int | None, upto: int | None, schema: object) -> DataFrame:
        """Rows with ``after`` < time <= ``upto`` (no bound where None)."""
        low = None if after is None else self.bucket(after + 1)
        high = None if upto is None else self.bucket(upto)
        chosen = [(b, k) for b, k in parts.live if (low is None or k >= low) and (high is None or k <= high)]
        if not chosen:
            return self.tables.spark.createDataFrame([], schema)
        rows = self.tables.spark.read.schema(schema).parquet(*(f"{self.tables.folder(self.name, b)}/_bucket={k}" for b, k in sorted(chosen)))
        if after is not None:
            rows = rows.where(F.col(self.at) > after)
        return rows if upto is None else rows.where(F.col(self.at) <= upto)

    def forget(self, parts: _Parts, before: int | None, batch: int) -> None:
        """End of a batch: write the list of parts without buckets that lie before that time as a whole."""
        gone = [] if before is None else [(b, k) for b, k in parts.live if self.start(k + 1) <= before]
        earlier = [(b, k, dropped) for b, k, dropped in self._list(batch) if dropped is not None]
        for b, k, dropped in earlier:
            if dropped <= batch - 2:
                remove(self.tables.spark, f"{self.tables.folder(self.name, b)}/_bucket={k}")
        left = set(gone)
        rows = [(b, k, None) for b, k in parts.live if (b, k) not in left] + [(b, k, batch) for b, k in gone]
        rows += [x for x in earlier if x[2] > batch - 2]
        self.tables.write(f"{self.name}_parts", self.tables.spark.createDataFrame(rows, _PARTS).coalesce(1), batch)
        if batch >= 2:
            self.tables.drop(f"{self.name}_parts", batch - 2)


class KeyState:
    """The latest row of each key, kept as changes that are merged now and then.

    A batch writes the rows of the keys that it changed. Reading takes the latest row of
    each key from the last merged table and the changes since; every ``merge_every``
    batches what is read is written as one table again. With ``ttl_us``, rows whose time
    lies that far behind the reader's mark are gone: they are not read, and the next
    merge leaves them out, so the table holds the keys of the last ``ttl_us`` and the
    changes since the last merge, however many keys there have ever been.
    """

    def __init__(self, tables: Tables, name: str, keys: Sequence[str], schema: str, at: str | None = None, ttl_us: int | None = None, merge_every: int = 8) -> None:
        self.tables, self.name, self.keys, self.at, self.ttl_us, self.merge_every = tables, name, list(keys), at, ttl_us, merge_every
        self.schema = schema

    def _since(self, batch: int) -> list[int]:
        """Batches whose folders make up the state before ``batch``: the last merge and what follows."""
        if batch == 0:
            return []
        return list(range((batch - 1) // self.merge_every * self.merge_every, batch))

    def _fresh(self, rows: DataFrame, mark: int | None) -> DataFrame:
        if self.ttl_us is None or self.at is None or mark is None:
            return rows
        return rows.where(F.col(self.at) > mark - self.ttl_us)

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in self.keys and c != "_batch"]
        newest = rows.groupBy(*self.keys).agg(F.max(F.struct("_batch", *others)).alias("_row"))
        return newest.select(*self.keys, *(F.col(f"_row.{c}").alias(c) for c in others))

    def read(self, batch: int, mark: int | None = None) -> DataFrame:
        """State before ``batch``, as of ``mark``."""
        parts = [self.tables.read(self.name, [b], self.schema).withColumn("_batch", F.lit(b)) for b in self._since(batch)]
        if not parts:
            return self.tables.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return self._fresh(self._latest(rows), mark)

    def change(self, rows: DataFrame, batch: int, mark: int | None = None) -> None:
        """Write the rows of the keys that a batch changed; each merging batch writes the whole state instead."""
        names = self.tables.spark.createDataFrame([], self.schema).columns
        rows = rows.select(*names)
        if batch % self.merge_every == 0 and batch > 0:
            known = self.read(batch, mark).select(*names).withColumn("_batch", F.lit(0))
            rows = self._fresh(self._latest(known.unionByName(rows.withColumn("_batch", F.lit(1)))), mark).select(*names)
        self.tables.write(self.name, rows, batch)
        # The batch before has merged, and is done: what it merged is not read again.
        if batch > 1 and (batch - 1) % self.merge_every == 0:
            for old in range(batch - 1 - self.merge_every, batch - 1):
                self.tables.drop(self.name, old)

    def rows_held(self, batch: int) -> int:
        """Rows that the folders of the state before ``batch`` have, merged or not."""
        return self.tables.read(self.name, self._since(batch), self.schema).count()


def whole_buckets(newest: int, delay_us: int, bucket_us: int) -> int:
    """The mark behind which nothing can come: the end of the last bucket that lies ``delay_us`` behind the newest time as a whole."""
    return (newest - delay_us) // bucket_us * bucket_us - 1
