"""The whole way from captured frames to query events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..options import Options
from . import assemble, decode, enrich
from .materialize import materialize


def frames_to_events(frames: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Query events with every derived column, and the frames that were rejected.

    Payloads are decoded once and written, because statements, types, requests and
    responses each read a few columns of them; so are the messages with
    their parameters decoded, which assembly reads several times.
    """
    good, rejected = decode.validate_frames(frames, options.max_frame_bytes)
    messages = materialize(decode.decode_frames(good))
    typed = assemble.resolve_param_types(messages, options.block_rows)
    ready = materialize(decode.decode_binds(messages, typed))
    events = assemble.assemble_events(ready, options)
    numbered = assemble.assign_sequence(events, "completed_us", "connection_id", "rank")
    return enrich.enrich(numbered, options), rejected
