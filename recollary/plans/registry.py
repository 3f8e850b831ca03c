"""Collects queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "2025-12-01 00:00:00"
#: Unicode white space, for DuckDB's regular expressions
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql is its DuckDB equivalent, if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{WS}'), lambda w: w <> '')"


#: memories as last delivered, chunks stored once, searches (each run once)
MEM = "mem AS (SELECT * FROM memories QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY ingested_at DESC, insert_seq DESC) = 1)"
CHUNK = "chk AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY insert_seq) = 1)"
RUN = "run AS (SELECT * FROM query_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY requested_at) = 1)"
SEARCH = f"{RUN}, search AS (SELECT run_id AS query_id, request.params.query AS query, request.params.top_k AS top_k, request.params.project_name AS project_name, relevance, ideal_hits, category FROM run WHERE request.method IN ('search_memory', 'search_in_project') AND request.params.query IS NOT NULL)"
EVENT = "ev AS (SELECT * FROM session_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at) = 1)"
