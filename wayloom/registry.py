"""All queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "locate_points"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``(table,)``, where ``table(name)`` reads a table, as query ``name``."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet"))
        QUERIES[name].__name__ = name
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


from wayloom.plans import catalog_queries, codec_queries, graph_queries, more_queries, raster_queries, sequence_queries, spatial_queries, view_queries  # noqa: E402,F401
