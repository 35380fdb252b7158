"""All registered queries: name -> (Spark query, DuckDB answer or None)."""

from __future__ import annotations

from . import event_queries, sink_queries, wire_queries

QUERIES = {**event_queries.QUERIES, **wire_queries.QUERIES, **sink_queries.QUERIES}
