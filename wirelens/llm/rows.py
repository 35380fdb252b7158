"""Rows told apart by doc_id and a hash of all their columns, and taken by these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def row_key(documents: DataFrame) -> Column:
    """A number that tells rows of one doc_id apart: a hash of the row."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in documents.columns))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as make them differ from all columns, whatever their case."""
    known = {c.lower() for c in columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in known for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def take_rows(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents by number: chosen has doc_id, row (``row_key``), copies and rows, one line for each.

    ``copies`` are to be taken in all from the ``rows`` rows that are alike. Such rows
    are alike in every column, so any of them may stand for the others. Columns may
    have any names.
    """
    own = [F.col(f"`{c}`") for c in documents.columns]
    id_, key, copies, rows, at, times, time = free_names(documents.columns, "id", "key", "copies", "rows", "at", "times", "time")
    totals = chosen.select(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("row").alias(key), F.col("copies").alias(copies), F.col("rows").alias(rows))
    alike = Window.partitionBy(id_, key).orderBy(F.lit(1))
    held = documents.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(id_), row_key(documents).alias(key)).withColumn(at, F.row_number().over(alike))
    taken = F.floor(F.col(copies) / F.col(rows)) + (F.col(at) <= F.pmod(copies, rows)).cast("long")
    joined = held.join(totals.where(F.col(copies) > 0), [id_, key]).withColumn(times, taken).where(F.col(times) > 0)
    return joined.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*own)
