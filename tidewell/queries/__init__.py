"""The registered queries and, where SQL can express them, their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.queries import adapters, browsing, duplicates, entities, flows, places, reports, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for module in (browsing, reports, entities, duplicates, texts, places, adapters, flows):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
