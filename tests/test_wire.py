"""A small session in wire frames: decoding, assembly, enrichment, and the client list."""

import datetime as dt
import ipaddress
import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from wirelens import schema
from wirelens.functions import wire
from wirelens.operators import assemble, compare, decode, enrich
from wirelens.options import Options


def z(*words):
    return b"".join(w.encode() + b"\0" for w in words)


def parse(name, query, *types):
    return ("c", "P", z(name, query) + struct.pack(f"!H{len(types)}I", len(types), *types))


def bind(name, codes, *values):
    body = z("", name) + struct.pack(f"!H{len(codes)}h", len(codes), *codes) + struct.pack("!H", len(values))
    for v in values:
        body += struct.pack("!i", -1) if v is None else struct.pack("!i", len(v)) + v
    return ("c", "B", body)


def row(*cells):
    return ("s", "D", struct.pack("!H", len(cells)) + b"".join(
        struct.pack("!i", -1) if c is None else struct.pack("!i", len(c)) + c for c in cells))


def columns(*names):
    return ("s", "T", struct.pack("!H", len(names)) + b"".join(z(n) + b"\0" * 18 for n in names))


def query(text):
    return ("c", "Q", z(text))


def done(tag):
    return ("s", "C", z(tag))


READY, EXECUTE = ("s", "Z", b"I"), ("c", "E", z("") + b"\0\0\0\0")
FAILED = ("s", "E", z("SERROR", "Mno such column") + b"\0")

SESSION = [
    query("BEGIN"), done("BEGIN"), READY,
    parse("by_id", "SELECT name FROM users WHERE id = $1", 23),
    *[f for i in (1, 2, 3, 1, 2) for f in (bind("by_id", [1], struct.pack("!i", i)), EXECUTE, columns("name"), row(b"n%d" % i, None, b"\xff\x00"), done("SELECT 1"))],
    query("SELECT missing FROM users"), FAILED, READY,
    ("c", "D", b"S" + z("late")), ("s", "t", struct.pack("!HI", 1, 20)), ("s", "t", struct.pack("!HI", 1, 16)),
    parse("other", "INSERT INTO users VALUES ($1, $2)", 25, 16),
    bind("late", [1], struct.pack("!q", -5)), EXECUTE, done("INSERT 0 4"),
    query("COMMIT"), done("COMMIT"), ("s", "C", z("SELECT 9")), query(""), query("SELECT 1"),
]


@pytest.fixture(scope="module")
def events(spark):
    frames = spark.createDataFrame(
        [("c1", i, 1_000_000 + i * 1000, side, kind, bytearray(body)) for i, (side, kind, body) in enumerate(SESSION)], schema.FRAMES)
    good, bad = decode.validate_frames(frames, Options().max_frame_bytes)
    assert bad.count() == 0
    messages = decode.decode_frames(good)
    typed = assemble.resolve_param_types(messages)
    ready = decode.decode_binds(messages, typed)
    options = Options(nplus1_threshold=5, nplus1_window_s=10.0)
    numbered = assemble.assign_sequence(assemble.assemble_events(ready, options), "completed_us", "connection_id", "rank")
    return enrich.enrich(numbered, options).orderBy("sequence").collect()


def test_session_events(events):
    seen = [(e.event_id, e.operation, e.query, list(e.args), e.rows_affected, e.error, e.status_tag) for e in events]
    lookup = "SELECT name FROM users WHERE id = $1"
    assert seen == [
        ("c1-1", "BEGIN", "BEGIN", [], 0, "", "BEGIN"),
        *[(f"c1-{n + 2}", "Execute", lookup, [str(i)], 1, "", "SELECT 1") for n, i in enumerate((1, 2, 3, 1, 2))],
        ("c1-7", "Query", "SELECT missing FROM users", [], 0, "no such column", "ERROR"),
        # The name was never parsed, so the latest statement runs, with the types the server told.
        ("c1-8", "Execute", "INSERT INTO users VALUES ($1, $2)", ["-5"], 4, "", "INSERT 0 4"),
        ("c1-9", "COMMIT", "COMMIT", [], 0, "", "COMMIT"),
        ("c1-10", "Query", "SELECT 1", [], 0, "connection closed", "DISCONNECTED"),
    ]
    assert [e.tx_id for e in events] == ["c1:1"] * 9 + [""]
    assert [e.n_plus_1 for e in events] == [False] * 5 + [True] + [False] * 4
    assert events[1].response_rows == [["n1", "NULL", "0xff00"]] and events[1].response_total_bytes == 4
    assert events[1].response_columns == ["name"] and events[1].duration_ms == 3.0


def test_parameters(spark):
    day = dt.datetime(2024, 5, 6, 7, 8, 9, 120, tzinfo=dt.timezone.utc)
    us = round((day - dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))
    some = uuid.uuid4()
    cases = [
        (b"ab\xff", 25, False, "ab�"), (struct.pack("!q", us), wire.TIMESTAMP, True, day.isoformat()),
        (struct.pack("!q", -1), wire.TIMESTAMPTZ, True, "1999-12-31T23:59:59.999999+00:00"), (b"\x01", wire.BOOL, True, "true"),
        (struct.pack("!h", -7), wire.INT2, True, "-7"), (struct.pack("!i", -2**31), wire.INT4, True, str(-2**31)),
        (struct.pack("!I", 2**32 - 1), wire.OID, True, "-1"), (struct.pack("!q", -2**63), wire.INT8, True, str(-2**63)),
        (some.bytes, wire.UUID, True, str(some)), (some.bytes, 0, True, str(some)), (b"\x0a\x0b", wire.BYTEA, True, "\\x0a0b"),
        (b"\x0a", 999, True, "0x0a"), (struct.pack("!h", 5), wire.INT8, True, "0x0005"), (None, 25, False, "NULL"), (b"", 25, False, ""),
    ]
    rows = spark.createDataFrame([(i, r if r is None else bytearray(r), t, b) for i, (r, t, b, _) in enumerate(cases)], "i int, r binary, t bigint, b boolean")
    found = rows.select("i", wire.decode_parameter(F.col("r"), F.col("t"), F.col("b")).alias("v")).orderBy("i").collect()
    assert [r.v for r in found] == [c[3] for c in cases]


def plain_fields(payload, at=0):
    count, at, out = int.from_bytes(payload[at:at + 2], "big"), at + 2, []
    for _ in range(count):
        head = payload[at:at + 4]
        size = int.from_bytes(head, "big", signed=len(head) == 4) if head else -1
        at += 4
        out.append(payload[at:at + size] if size >= 0 else None)
        at += max(size, 0)
    return out


def plain_names(payload):
    at, out = 2, []
    for _ in range(int.from_bytes(payload[:2], "big")):
        end = payload.find(b"\0", at)
        end = max(at, len(payload)) if end < 0 else end
        out.append(payload[at:end].decode("utf-8", "replace"))
        at = end + 19
    return out


def test_lists_of_all_lengths(spark):
    """Lists read by cursors over a whole batch against one payload at a time: whole, cut short anywhere, malformed, empty, null."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        cells = [None if rng.random() < 0.2 else rng.randbytes(rng.choice((0, 1, 3, 300))) for _ in range(rng.choice((0, 1, 2, 9, 70)))]
        data = row(*cells)[2]
        named = columns(*[rng.choice(("", "id", "größe", "n" * 40)) for _ in range(rng.randrange(5))])[2]
        bound = bind(rng.choice(("", "stmt", "größe")), [rng.choice((0, 1, -3)) for _ in range(rng.randrange(4))], *cells)[2]
        rows += [(data, named, bound), *((data[:rng.randrange(len(data) + 1)], named[:rng.randrange(len(named) + 1)], bound[:rng.randrange(len(bound) + 1)]) for _ in range(2))]
    rows += [(b"", b"", b""), (None, None, None), (b"\0\2\xff\xff\xff\xfe\0\0\0\1a", b"\0\1a\xffb\0", b"\0\0"), (b"\xff\xff\0", b"\0\3", b"x"), (rng.randbytes(50), rng.randbytes(50), rng.randbytes(50))]
    frame = spark.createDataFrame([(i, *(x if x is None else bytearray(x) for x in r)) for i, r in enumerate(rows)], "i int, d binary, n binary, b binary")
    found = frame.repartition(3).select("i", wire.decode_data_row(F.col("d")).alias("d"), wire.decode_row_description(F.col("n")).alias("n"), wire.decode_bind(F.col("b")).alias("b")).orderBy("i").collect()

    def plain_bind(payload):
        at, names = 0, []
        for _ in range(2):
            end = payload.find(b"\0", at)
            end = max(len(payload), at) if end < 0 else end
            names.append(payload[at:end].decode("utf-8", "replace"))
            at = end + 1
        count, at = int.from_bytes(payload[at:at + 2], "big"), at + 2
        codes = [payload[at + 2 * k:at + 2 * k + 2] for k in range(count)]
        return *names, [int.from_bytes(c, "big", signed=len(c) == 2) if c else None for c in codes], plain_fields(payload, at + 2 * count)

    for got, (d, n, b) in zip(found, rows, strict=True):
        assert got.d == (None if d is None else plain_fields(d)) and got.n == (None if n is None else plain_names(n))
        assert tuple(got.b) == ((None,) * 4 if b is None else plain_bind(b))
    assert frame.where("i < 0").select(wire.decode_data_row(F.col("d"))).count() == 0


@pytest.mark.parametrize("tag, rows", [("INSERT 0 5", 5), ("BEGIN", 0), ("", 0), ("SELECT  7 ", 7), ("X 1.5", 0), ("COPY -1", -1)])
def test_rows_affected(spark, tag, rows):
    assert spark.range(1).select(wire.rows_affected(F.lit(tag))).head()[0] == rows


def test_errors(spark):
    cases = [(z("SERROR", "Mfirst", "Msecond") + b"\0", "second"), (z("SERROR") + b"\0", wire.DEFAULT_ERROR), (z("S", "M") + b"\0", ""),
             (z("Mshown") + b"\0" + z("Mafter"), "shown")]
    rows = spark.createDataFrame([(bytearray(c),) for c, _ in cases], "p binary").select(wire.decode_error(F.col("p")))
    assert [r[0] for r in rows.collect()] == [w for _, w in cases]


def test_frame_limits(spark):
    rows = spark.createDataFrame([(bytearray(b"x" * n),) for n in (0, 6, 7)], "payload binary")
    good, bad = decode.validate_frames(rows, 10)
    assert (good.count(), bad.count()) == (2, 1)


def test_client_list(spark):
    hosts = ["10.1.2.3", "10.2.0.127", "10.2.0.128", "10.1.2", "010.1.2.3", "10.1.2.300", "fe80::1%eth0", "fe80::1", "2001:db8::5",
             "2001:DB8:0:0:0:0:0:5", "2001:db9::", "::ffff:10.1.2.3", ":::", "1::2::3", "2001:db8::1:2:3:4:5:6:7", "", "host", "::"]
    line = "10.1.0.0/16, 10.2.0.0/25, 2001:db8::/32, fe80::1, ::/127"

    def allowed(host):
        try:
            address = ipaddress.ip_address(host.split("%", 1)[0])
        except ValueError:
            return False
        return any(address in ipaddress.ip_network(n.strip()) for n in line.split(","))

    rows = spark.createDataFrame([(h,) for h in hosts], "client_host string")
    found = {r.client_host for r in compare.allow_clients(rows, line).collect()}
    assert found == {h for h in hosts if allowed(h)}
    assert compare.allow_clients(rows, "").count() == len(hosts)
