"""Every registered query of the core, with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codequarry.plans import code, graphs, rendered, retrieval, samples, values

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (retrieval, code, graphs, rendered, samples, values)
QUERIES: dict[str, Query] = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _PARTS for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search, end to end."""
    return retrieval.i3_hybrid_search(spark, sf)
