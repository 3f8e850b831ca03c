"""The tables as the queries use them: each row once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollary.operators import sessions, tables
from recollary.plans.registry import AS_OF
from recollary.session import load


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def memories(spark: SparkSession, d: str, **more: Column) -> DataFrame:
    """more: further columns, computed before rows are moved; what they are computed from is moved only if it is read."""
    return tables.newest(load(spark, d, "memories").withColumns(more), "memory_id", F.col("ingested_at").desc(), F.col("insert_seq").desc())


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return tables.newest(load(spark, d, "chunks"), "chunk_id", F.col("insert_seq"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return tables.newest(load(spark, d, "query_runs"), "run_id", F.col("requested_at"))


def searches(spark: SparkSession, d: str) -> DataFrame:
    p = "request.params."
    rows = runs(spark, d).where("request.method in ('search_memory', 'search_in_project') and request.params.query is not null")
    return rows.select(F.col("run_id").alias("query_id"), p + "query", p + "top_k", p + "project_name", "relevance", "ideal_hits", "category")


def stated(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches against all rows: runs whose id is divisible by 100."""
    return searches(spark, d).where("query_id % 100 = 0")


def events(spark: SparkSession, d: str) -> DataFrame:
    return sessions.once(load(spark, d, "session_events"))
