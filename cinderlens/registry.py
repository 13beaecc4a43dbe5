"""All queries over the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderlens.functions import sanitize, scalars
from cinderlens.operators import classify, detections, diffs, extract, history, records, references, reports, retrieval, rules, search, tools
from cinderlens.sources import heads
from cinderlens.streaming import ingest, state

_PARTS = (detections, diffs, records, history, retrieval, search, scalars, sanitize, heads, reports, references, extract, classify, rules, tools, ingest, state)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL, for queries that SQL can express."""
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
