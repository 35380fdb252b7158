"""Frames -> decoded messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import wire

# Message letters by direction.
CLIENT = {"Q": "Query", "P": "Parse", "D": "Describe", "B": "Bind", "E": "Execute"}
SERVER = {"T": "RowDesc", "D": "DataRow", "t": "ParamDesc", "C": "Complete", "E": "Error", "Z": "Ready"}


def validate_frames(frames: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Frames within the size limit, and the rejected ones with the reason.

    The length field of a frame counts itself: payload bytes + 4.
    """
    size = F.coalesce(F.octet_length("payload"), F.lit(-1)) + 4
    checked = frames.withColumn("size", size).withColumn(
        "problem",
        F.when(F.col("size") < 4, F.lit("invalid packet length"))
        .when(F.col("size") > max_bytes, F.format_string("packet is too large (%d bytes > limit %d bytes)", "size", F.lit(max_bytes))))
    return checked.where(F.col("problem").isNull()).drop("size", "problem"), checked.where(F.col("problem").isNotNull())


def _kind() -> Column:
    kind = F
    for side, letters in (("c", CLIENT), ("s", SERVER)):
        for letter, name in letters.items():
            kind = kind.when((F.col("direction") == side) & (F.col("msg_type") == letter), F.lit(name))
    return kind


def decode_frames(frames: DataFrame) -> DataFrame:
    """One row per message that matters, with the fields of its kind.

    Each decoder sits behind its kind in a CASE, so a row pays for its own only; the
    Arrow functions get the payloads of their own kind and null for the others.
    """
    body = F.col("payload")

    def only(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    decoded = frames.withColumn("kind", _kind()).where(F.col("kind").isNotNull()).withColumns({
        "_parse": only("Parse", wire.decode_parse(body)),
        "_describe": only("Describe", wire.decode_describe(body)),
        "_bind": only("Bind", wire.decode_bind(only("Bind", body))),
        "cells_raw": wire.decode_data_row(only("DataRow", body)),
    })
    # Of Describes only those of a statement count.
    kept = decoded.where((F.col("kind") != "Describe") | (F.col("_describe.object") == "S"))
    return kept.select(
        "connection_id", "frame_no", "captured_us", "kind",
        F.coalesce("_parse.statement_name", "_bind.statement_name", "_describe.statement_name").alias("statement_name"),
        F.coalesce("_parse.query", only("Query", wire.decode_query(body))).alias("query"),
        F.coalesce("_parse.type_ids", only("ParamDesc", wire.decode_param_description(body))).alias("type_ids"),
        F.col("_bind.format_codes").alias("format_codes"), F.col("_bind.params").alias("params"),
        only("Complete", wire.decode_command_tag(body)).alias("tag"),
        only("Error", wire.decode_error(body)).alias("error"),
        wire.decode_row_description(only("RowDesc", body)).alias("columns"),
        F.transform("cells_raw", wire.cell_text).alias("cells"),
        F.aggregate("cells_raw", F.lit(0).cast("bigint"),
                    lambda n, c: n + F.coalesce(F.octet_length(c), F.lit(0))).alias("cell_bytes"),
    )


def decode_binds(messages: DataFrame, typed_binds: DataFrame) -> DataFrame:
    """Put argument texts on Bind messages; ``typed_binds`` carries ``bind_types``."""
    args = wire.decode_args(F.col("params"), F.col("format_codes"), F.col("bind_types"))
    others = messages.where(F.col("kind") != "Bind").withColumn("args", F.lit(None).cast("array<string>"))
    binds = typed_binds.withColumn("args", args).drop("bind_types")
    return others.drop("params", "format_codes").unionByName(binds.drop("params", "format_codes"))
