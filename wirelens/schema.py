"""Row types. Absent text is '' and never null, as the filter language expects."""

from pyspark.sql import types as T

_text = T.StringType()
_long = T.LongType()
_flag = T.BooleanType()
_texts = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# One captured wire frame. direction is 'c' (client) or 's' (server); frame_no
# rises along each connection over both directions.
FRAMES = _struct(
    connection_id=_text, frame_no=_long, captured_us=_long,
    direction=_text, msg_type=_text, payload=T.BinaryType(),
)

# One query event, the fact row of every analysis.
EVENT = _struct(
    event_id=_text, sequence=_long, connection_id=_text, operation=_text, query=_text,
    args=_texts, started_us=_long, duration_ms=T.DoubleType(), rows_affected=_long,
    error=_text, tx_id=_text, status_tag=_text, slow=_flag, n_plus_1=_flag,
    n_plus_1_scope=_text, n_plus_1_hits=_long, n_plus_1_distinct_args=_long,
    normalized_query=_text, response_columns=_texts,
    response_rows=T.ArrayType(_texts), response_total_rows=_long,
    response_total_bytes=_long, response_truncated=_flag,
)

_response = _struct(
    rows=_long, bytes=_long, columns=_texts, preview_rows=T.ArrayType(_texts),
    preview_count=_long, truncated=_flag,
)

# One exported record; the widest profile. Narrower profiles leave fields null.
RECORD = _struct(
    time=_text, operation=_text, query=_text, duration_ms=T.DoubleType(),
    rows_affected=_long, status=_text, response=_response, connection_id=_text,
    tx_id=_text, args=_texts, error=_text, slow=_flag, n_plus_1=_flag,
    n_plus_1_scope=_text, n_plus_1_hits=_long, n_plus_1_distinct_args=_long,
    normalized_query=_text, event_id=_text, sequence=_long,
    response_truncated=_flag, response_columns=_texts,
)

DOCUMENT = _struct(
    captured=_long, filter=_text, profile=_text, response_body=_text,
    queries=T.ArrayType(RECORD),
)
