"""Decoding of wire message payloads: built-in expressions, and Arrow functions for lists of items of their own lengths.

Payloads are byte strings. Offsets into them are byte offsets, kept zero-based
as in the message layouts; ``_bytes`` turns them into Spark's one-based ones.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from . import text

# Task functions travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Parameter type ids and the wire epoch (2000-01-01, Unix microseconds).
BOOL, BYTEA, INT8, INT2, INT4, OID, TIMESTAMP, TIMESTAMPTZ, UUID = 16, 17, 20, 21, 23, 26, 1114, 1184, 2950
WIRE_EPOCH_US = 946_684_800_000_000

BIND = (StructType().add("portal", BinaryType()).add("statement_name", BinaryType())
        .add("format_codes", ArrayType(LongType())).add("params", ArrayType(BinaryType())))
DEFAULT_ERROR = "PostgreSQL error"
NULL_TEXT = "NULL"


def _bytes(payload: Column, offset: Column | int, length: Column | int) -> Column:
    start = F.lit(offset) if isinstance(offset, int) else offset
    size = F.lit(length) if isinstance(length, int) else length
    return F.substring(payload, start + 1, size)


def _unsigned(raw: Column, width: int) -> Column:
    """Big-endian number; eight bytes need a decimal, fewer fit a bigint."""
    return F.conv(F.hex(raw), 16, 10).cast("bigint" if width < 8 else "decimal(20,0)")


def _signed(raw: Column, width: int) -> Column:
    # Shifted by half the range and back, so the bytes are read only once.
    kind = "bigint" if width < 8 else "decimal(20,0)"
    half, whole = F.lit(str(2 ** (8 * width - 1))).cast(kind), F.lit(str(2 ** (8 * width))).cast(kind)
    return (F.pmod(_unsigned(raw, width) + half, whole) - half).cast("bigint")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uint16(payload: Column, offset: Column | int) -> Column:
    return _unsigned(_bytes(payload, offset, 2), 2).cast("int")


def int32(payload: Column, offset: Column | int) -> Column:
    return _signed(_bytes(payload, offset, 4), 4).cast("int")


def utf8(raw: Column) -> Column:
    """Text of the bytes; malformed sequences become the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def _until_nul(payload: Column, offset: Column | int, skip: int = 0) -> Column:
    """Bytes from ``offset`` (plus ``skip`` further strings) up to the next NUL.

    A binary cast to string keeps its bytes, and substring_index compares bytes,
    so malformed text needs no special care here.
    """
    rest = _bytes(payload, offset, F.octet_length(payload)).cast("string")
    upto = F.substring_index(rest, "\0", skip + 1)
    if skip == 0:
        return upto.cast("binary")
    passed = F.octet_length(F.substring_index(rest, "\0", skip)) + 1
    return _bytes(upto.cast("binary"), passed, F.octet_length(upto))


def _numbers(payload: Column, offset: Column, count: Column, width: int, signed: bool) -> Column:
    """``count`` big-endian integers from ``offset`` on."""
    def read(at: Column) -> Column:
        raw = _bytes(payload, at, width)
        return _signed(raw, width) if signed else _unsigned(raw, width)

    none = F.array().cast("array<bigint>")
    return _let(F.struct(offset.cast("int").alias("at"), count.alias("n")), lambda s: F.when(
        s["n"] > 0, F.transform(F.sequence(s["at"], s["at"] + (s["n"] - 1) * width, F.lit(width)), read)).otherwise(none))


class _Payloads:
    """A batch of payloads as one run of bytes, read at a cursor for each payload.

    A cursor moves through all payloads at once: a list of n items takes n steps for
    the whole batch, and no payload becomes an object of its own. What lies behind the
    end of a payload reads as no bytes.
    """

    def __init__(self, column: pa.Array) -> None:
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        self.bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.missing = np.asarray(column.is_null())
        self.at, self.end = edges[:-1].copy(), np.where(self.missing, edges[:-1], edges[1:])
        self._nuls: np.ndarray | None = None

    def number(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Big-endian number of up to ``width`` bytes, and how many bytes there are; cursors go ``width`` on."""
        at = self.at[rows]
        there = np.clip(self.end[rows] - at, 0, width)
        value = np.zeros(len(rows), np.int64)
        for i in range(width):
            byte = self.bytes[np.minimum(at + i, len(self.bytes) - 1)]
            value = np.where(i < there, value * 256 + byte, value)
        self.at[rows] = at + width
        return value, there

    def string(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the text up to the next NUL; cursors go behind that."""
        if self._nuls is None:
            self._nuls = np.append(np.flatnonzero(self.bytes == 0), np.iinfo(np.int64).max)
        at, end = self.at[rows], self.end[rows]
        stop = np.maximum(np.minimum(self._nuls[np.searchsorted(self._nuls, at)], end), at)
        self.at[rows] = stop + 1
        return at, stop - at

    def values(self, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Byte strings by start and size; size -1 is null."""
        kept = np.maximum(sizes, 0)
        ends = np.concatenate([[0], np.cumsum(kept)])
        copied = self.bytes[np.repeat(starts - ends[:-1], kept) + np.arange(ends[-1])]
        valid = pa.array(sizes >= 0).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(copied)])

    def lists(self, counts: np.ndarray, items: pa.Array) -> pa.Array:
        """One list for each payload, null for a missing one."""
        edges = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items, mask=pa.array(self.missing))

    def codes(self) -> pa.Array:
        """A count, then signed numbers of two bytes; what is missing is null."""
        rows = np.arange(len(self.at))
        counts, _ = self.number(rows, 2)
        first, behind = np.cumsum(counts) - counts, self.at + 2 * counts
        found, known = np.zeros(int(counts.sum()), np.int64), np.zeros(int(counts.sum()), bool)
        place = 0
        while len(rows := rows[(counts[rows] > place) & (self.at[rows] < self.end[rows])]):
            slot = first[rows] + place
            value, _ = self.number(rows, 2)
            found[slot], known[slot] = np.where(value >= 1 << 15, value - (1 << 16), value), True
            place += 1
        self.at = behind
        return self.lists(counts, pa.array(found, mask=~known))

    def fields(self) -> pa.Array:
        """A count, then byte strings with their length before them; length -1 is null.

        Where a payload ends too early, what is missing is null.
        """
        rows = np.arange(len(self.at))
        counts, _ = self.number(rows, 2)
        first = np.cumsum(counts) - counts
        starts, sizes = np.zeros(int(counts.sum()), np.int64), np.full(int(counts.sum()), -1, np.int64)
        place = 0
        while len(rows := rows[(counts[rows] > place) & (self.at[rows] < self.end[rows])]):
            length, there = self.number(rows, 4)
            length = np.where((there == 4) & (length >= 1 << 31), -1, length)
            at, slot = self.at[rows], first[rows] + place
            # A payload that ends early holds what is there of the field.
            starts[slot] = at
            sizes[slot] = np.where(length < 0, -1, np.clip(self.end[rows] - at, 0, length))
            self.at[rows] = at + np.maximum(length, 0)
            place += 1
        return self.lists(counts, self.values(starts, sizes))


@F.arrow_udf(ArrayType(BinaryType()))
def _cells_of(payloads: pa.Array) -> pa.Array:
    """Fields of a batch of data rows."""
    return _Payloads(payloads).fields()


@F.arrow_udf(BIND)
def _bind_of(payloads: pa.Array) -> pa.Array:
    """A batch of binds: two names, format codes, parameters."""
    batch = _Payloads(payloads)
    rows = np.arange(len(payloads))
    columns = [batch.values(*batch.string(rows)) for _ in range(2)] + [batch.codes(), batch.fields()]
    names = ["portal", "statement_name", "format_codes", "params"]
    return pa.StructArray.from_arrays(columns, names, mask=pa.array(batch.missing))


@F.arrow_udf(ArrayType(StringType()))
def _names_of(payloads: pa.Array) -> pa.Array:
    """Names of a batch of row descriptions: each ends with NUL and has 18 bytes of detail."""
    batch = _Payloads(payloads)
    rows = np.arange(len(payloads))
    counts, _ = batch.number(rows, 2)
    first = np.cumsum(counts) - counts
    starts, sizes = np.zeros(int(counts.sum()), np.int64), np.zeros(int(counts.sum()), np.int64)
    place = 0
    while len(rows := rows[(counts[rows] > place) & (batch.at[rows] < batch.end[rows])]):
        slot = first[rows] + place
        starts[slot], sizes[slot] = batch.string(rows)
        batch.at[rows] += 18
        place += 1
    names = batch.values(starts, sizes)
    try:
        names = names.cast(pa.string())
    except pa.ArrowInvalid:  # malformed text
        names = pa.array([x.decode("utf-8", "replace") for x in names.to_pylist()], pa.string())
    return batch.lists(counts, names)


def decode_query(payload: Column) -> Column:
    size = F.octet_length(payload)
    ends = (size > 0) & (F.hex(_bytes(payload, size - 1, 1)) == "00")
    return utf8(F.when(ends, _bytes(payload, 0, size - 1)).otherwise(payload))


def _two_names(payload: Column) -> Column:
    """The two leading strings and the offset behind them."""
    return _let(F.struct(_until_nul(payload, 0).alias("a"), _until_nul(payload, 0, 1).alias("b")), lambda s: F.struct(
        s["a"].alias("a"), s["b"].alias("b"), (F.octet_length(s["a"]) + F.octet_length(s["b"]) + 2).alias("at")))


def decode_parse(payload: Column) -> Column:
    return _let(_two_names(payload), lambda head: F.struct(
        utf8(head["a"]).alias("statement_name"), utf8(head["b"]).alias("query"),
        _numbers(payload, head["at"] + 2, uint16(payload, head["at"]), 4, signed=False).alias("type_ids"),
    ))


def decode_describe(payload: Column) -> Column:
    """Object kind and name; null for an empty payload."""
    return F.when(F.octet_length(payload) > 0, F.struct(
        utf8(_bytes(payload, 0, 1)).alias("object"), utf8(_until_nul(payload, 1)).alias("statement_name")))


def decode_bind(payload: Column) -> Column:
    bind = _bind_of(payload)
    return F.struct(utf8(bind["portal"]).alias("portal"), utf8(bind["statement_name"]).alias("statement_name"),
                    bind["format_codes"].alias("format_codes"), bind["params"].alias("params"))


def decode_row_description(payload: Column) -> Column:
    """Column names; each is followed by 18 bytes of type detail."""
    return _names_of(payload)


def decode_data_row(payload: Column) -> Column:
    return _cells_of(payload)


def decode_param_description(payload: Column) -> Column:
    return _numbers(payload, F.lit(2), uint16(payload, 0), 4, signed=False)


def decode_command_tag(payload: Column) -> Column:
    return decode_query(payload)


def rows_affected(tag: Column) -> Column:
    """Last word of the tag where it is a whole number, else 0."""
    word = F.regexp_extract(tag, r"(\S+)\s*$", 1)
    return F.coalesce(F.when(word.rlike(r"^[+-]?\d+$"), word.try_cast("bigint")), F.lit(0).cast("bigint"))


def decode_error(payload: Column) -> Column:
    """Text of the last M field before the closing NUL."""
    fields = F.split(utf8(payload), "\0", -1)
    closing = F.array_position(fields, F.lit("")).cast("int")
    inside = F.when(closing > 0, F.slice(fields, F.lit(1), closing - 1)).otherwise(fields)
    message = F.try_element_at(F.filter(inside, lambda f: f.startswith("M")), F.lit(-1))
    return F.coalesce(F.substring(message, 2, 2147483647), F.lit(DEFAULT_ERROR))


def is_binary_param(codes: Column, index: Column) -> Column:
    return (
        F.when(F.size(codes) == 0, F.lit(False))
        .when(F.size(codes) == 1, F.get(codes, F.lit(0)) == 1)
        .otherwise(F.coalesce(F.get(codes, index) == 1, F.lit(False)))
    )


def pg_timestamp(us: Column) -> Column:
    """Wire microseconds as ISO text in UTC."""
    unix = us + F.lit(WIRE_EPOCH_US)
    return text.iso_time(unix)


def _uuid(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(raw)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def decode_parameter(raw: Column, type_id: Column, is_binary: Column) -> Column:
    """Text of one bound value; null becomes the word NULL."""
    size, digits = F.octet_length(raw), F.lower(F.hex(raw))
    return (
        F.when(raw.isNull(), F.lit(NULL_TEXT))
        .when(~is_binary, utf8(raw))
        .when(type_id.isin(TIMESTAMP, TIMESTAMPTZ) & (size == 8), pg_timestamp(_signed(raw, 8)))
        .when((type_id == BOOL) & (size == 1), F.when(digits == "00", F.lit("false")).otherwise(F.lit("true")))
        .when((type_id == INT2) & (size == 2), _signed(raw, 2).cast("string"))
        .when(type_id.isin(INT4, OID) & (size == 4), _signed(raw, 4).cast("string"))
        .when((type_id == INT8) & (size == 8), _signed(raw, 8).cast("string"))
        .when((type_id == BYTEA), F.concat(F.lit("\\x"), digits))
        .when(size == 16, _uuid(raw))
        .otherwise(F.concat(F.lit("0x"), digits))
    )


def decode_args(params: Column, codes: Column, type_ids: Column) -> Column:
    return F.transform(params, lambda raw, i: decode_parameter(
        raw, F.coalesce(F.get(type_ids, i), F.lit(0).cast("bigint")), is_binary_param(codes, i)))


def cell_text(raw: Column) -> Column:
    """Text of one result cell; bytes that are not UTF-8 show as hex."""
    as_text = raw.cast("string")
    return (
        F.when(raw.isNull(), F.lit(NULL_TEXT))
        .when(F.is_valid_utf8(as_text), as_text)
        .otherwise(F.concat(F.lit("0x"), F.lower(F.hex(raw))))
    )
