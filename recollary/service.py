"""The tool methods as operations over tables.

A Service holds DataFrames (memories, chunks, projects, bookmarks, session_events). Reading methods return a
DataFrame; changing ones return a new Service, and nothing is written until a table is. Methods that answer
one caller are small plans over the same operators as the batch queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollary.operators import bm25, catalog, consolidate, hybrid, ingest, sessions, tables, vectors
from recollary.plugins import Models

NOT_FOUND, BAD_REQUEST, BAD_PARAMS = -32601, -32600, -32602


class RequestError(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Service:
    memories: DataFrame
    chunks: DataFrame
    projects: DataFrame
    bookmarks: DataFrame
    session_events: DataFrame
    as_of: Column
    models: Models = field(default_factory=Models)

    # -- memories ------------------------------------------------------------------------------
    def ingest_conversation(self, conversations: DataFrame) -> Service:
        """Adds conversations (one or many) as memories and embedded chunks; rows without text are left out."""
        made, _ = ingest.remember(conversations, self.as_of)
        cut = ingest.chunks(made).withColumn("embedding", self.models.embed(F.col("content")))
        inherited = made.select("memory_id", "source", "created_at")
        return replace(
            self,
            memories=tables.upsert(self.memories, made, "memory_id"),
            chunks=tables.upsert(self.chunks, cut.join(inherited, "memory_id"), "chunk_id"),
        )

    def search_memory(self, queries: DataFrame, strict_filters: bool = False) -> DataFrame:
        """Hybrid results of queries (query_id, query, top_k, project_name)."""
        entries = tables.entries(self.memories, self.chunks)
        named = catalog.resolve_projects(queries, self.projects)
        wanted = named.withColumn("wanted_project", F.when(F.col("project_name").isNotNull(), F.col("project_id"))).select("query_id", "query", "top_k", "wanted_project")
        near = vectors.nearest(entries, queries.select("query_id", self.models.embed(F.col("query")).alias("query_vector")), hybrid.VECTOR_K, "entry_id")
        hits = bm25.search(self.chunks, queries, hybrid.BM25_K).withColumnRenamed("chunk_id", "entry_id")
        return hybrid.hybrid(entries, wanted, near, hits, self.as_of, strict_filters=strict_filters)

    def search_in_project(self, queries: DataFrame) -> DataFrame:
        """Results from the project's pool where they suffice, else those of the whole collection."""
        entries = tables.entries(self.memories, self.chunks)
        pooled = hybrid.pool(entries).select("memory_id").distinct()
        found = self.search_memory(queries, strict_filters=True)
        return hybrid.project_search(found.join(pooled, "memory_id", "left_semi").select(found.columns), self.search_memory(queries), queries)

    def get_memory(self, memory_id: str) -> DataFrame:
        """One row for the memory or entry id, with its chunks in order; none if it is unknown."""
        own = self.memories.where((F.col("memory_id") == memory_id) | (F.col("entry_id") == memory_id))
        # the chunks of this memory only
        parts = self.chunks.join(own.select("memory_id"), "memory_id", "left_semi").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("chunks"))
        return own.join(parts, "memory_id", "left")

    def list_recent_memories(self, limit: int = 10, filters: dict[str, object] | None = None) -> DataFrame:
        return catalog.list_recent(self.memories, limit, tables.matching(self.memories, filters) if filters else None)

    def consolidate_memories(self, cluster: Column | None = None) -> tuple[Service, DataFrame]:
        kept, rest, stats = consolidate.consolidate(self.memories, self.chunks, self.as_of, cluster)
        return replace(self, memories=kept, chunks=rest), stats

    # -- sessions ------------------------------------------------------------------------------
    def add_command(self, events: DataFrame) -> Service:
        return replace(self, session_events=self.session_events.unionByName(events, allowMissingColumns=True))

    start_session = add_command  # a session exists from its first event on

    def end_session(self, session_id: str) -> Service:
        """The session's events become a memory and leave the table."""
        mine = self.session_events.where(F.col("session_id") == session_id)
        talk = ingest.session_conversations(sessions.log_lines(mine), sessions.summaries(mine))
        return replace(self.ingest_conversation(talk), session_events=self.session_events.where(~(F.col("session_id") == session_id)))

    def session_get_hint(self) -> DataFrame:
        return sessions.hints(self.session_events)

    def session_set_project(self, event: DataFrame) -> Service:
        """event: a session event whose metadata names the project."""
        return self.add_command(event)

    def session_clear_project(self, session_id: str) -> Service:
        clear = F.when(F.col("session_id") == session_id, F.map_filter("metadata", lambda k, _: ~k.isin("project_name", "project_id", "cwd"))).otherwise(F.col("metadata"))
        return replace(self, session_events=self.session_events.withColumn("metadata", clear))

    # -- projects and bookmarks ------------------------------------------------------------------
    def create_project(self, projects: DataFrame) -> Service:
        """Projects whose name is taken, without regard to case, are left out."""
        taken = self.projects.select(F.lower("name").alias("_n"))
        fresh = projects.join(taken, F.lower("name") == F.col("_n"), "left_anti")
        return replace(self, projects=self.projects.unionByName(fresh, allowMissingColumns=True))

    def list_projects(self) -> DataFrame:
        return self.projects.orderBy(F.col("last_accessed").desc_nulls_last(), "id")

    def get_project(self, name: str) -> DataFrame:
        return self.projects.where((F.col("id") == name) | (F.lower("name") == name.lower())).orderBy(F.col("id") != name, "created_at", "id").limit(1)

    def delete_project(self, project_id: str) -> Service:
        return replace(self, projects=self.projects.where(F.col("id") != project_id))

    def create_bookmark(self, bookmarks: DataFrame) -> Service:
        return replace(self, bookmarks=tables.upsert(self.bookmarks, bookmarks, "bookmark_id"))

    def list_bookmarks(self) -> DataFrame:
        return self.bookmarks.orderBy(F.col("usage_count").desc_nulls_last(), F.col("last_used").desc_nulls_last(), "bookmark_id")

    def use_bookmark(self, uses: DataFrame) -> tuple[Service, DataFrame]:
        """Counts uses (bookmark_id, used_at) and runs the bookmarks' queries."""
        queries = self.bookmarks.join(uses.select("bookmark_id").distinct(), "bookmark_id").select(F.col("bookmark_id").alias("query_id"), "query", F.lit(None).cast("int").alias("top_k"), F.lit(None).cast("string").alias("project_name"))
        return replace(self, bookmarks=catalog.use_bookmarks(self.bookmarks, uses)), self.search_memory(queries)

    def index_stats(self) -> DataFrame:
        """memories, chunks and projects held."""
        counts = [df.agg(F.count("*").alias(name)) for name, df in (("memories", self.memories), ("chunks", self.chunks), ("projects", self.projects))]
        return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


METHODS = {name: getattr(Service, name) for name in vars(Service) if not name.startswith("_") and callable(getattr(Service, name))}


def dispatch(service: Service, request: dict) -> Callable:
    """The bound method that a JSON-RPC request names; RequestError for a malformed or unknown one."""
    if request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        raise RequestError(BAD_REQUEST, "not a JSON-RPC 2.0 request")
    if request["method"] not in METHODS:
        raise RequestError(NOT_FOUND, f"unknown method {request['method']!r}")
    if not isinstance(request.get("params", {}), dict):
        raise RequestError(BAD_PARAMS, "params must be an object")
    return getattr(service, request["method"])
