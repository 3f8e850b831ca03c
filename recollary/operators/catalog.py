"""Projects, bookmarks and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollary.functions.text import looks_like_uuid, normalised_name, words


def list_recent(memories: DataFrame, limit: int = 10, where: Column | None = None) -> DataFrame:
    """The newest memories with a short summary. A report: limit is its purpose."""
    rows = memories if where is None else memories.where(where)
    short = F.when(F.length("summary") > 200, F.concat(F.substring("summary", 1, 200), F.lit("..."))).otherwise(F.col("summary"))
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "memory_id").limit(limit).select("memory_id", "created_at", short.alias("summary"))


def with_all_tags(projects: DataFrame, tags: list[str]) -> DataFrame:
    """Projects that carry every one of the tags, in any case, last used first."""
    have = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    wanted = F.array(*[F.lit(t.lower()) for t in tags]).cast("array<string>")
    return projects.where(F.size(F.array_except(wanted, have)) == 0).orderBy(F.col("last_accessed").desc_nulls_last(), "id")


def resolve_projects(names: DataFrame, projects: DataFrame, name: str = "project_name") -> DataFrame:
    """names with project_id: by id, else by name (case, spaces and hyphens aside, first created), else a uuid as it is."""
    named = projects.where(F.col("name").isNotNull()).groupBy(normalised_name("name").alias("_name")).agg(F.min_by("id", F.struct("created_at", "id")).alias("_by_name"))
    ids = projects.select(F.col("id").alias("_id"))
    joined = names.join(ids, F.col(name) == F.col("_id"), "left").join(named, normalised_name(name) == F.col("_name"), "left")
    passed = F.when(looks_like_uuid(name), F.col(name))
    return joined.withColumn("project_id", F.coalesce("_id", "_by_name", passed)).drop("_id", "_name", "_by_name")


def project_counts(projects: DataFrame, memories: DataFrame) -> DataFrame:
    """id, name, stored (the stale counter), counted, drift."""
    real = memories.groupBy("project_id").agg(F.count("*").alias("n"))
    joined = projects.join(real, projects["id"] == real["project_id"], "left")
    counted = F.coalesce("n", F.lit(0))
    return joined.select("id", "name", F.col("memory_count").alias("stored"), counted.alias("counted"), (F.coalesce("memory_count", F.lit(0)) - counted).alias("drift"))


def recommend(contexts: DataFrame, bookmarks: DataFrame, k: int = 3) -> DataFrame:
    """query_id, bookmark_id, score, rank: bookmarks by shared words plus 0.1 x usage, if any word is shared.

    contexts: query_id, query. bookmarks: bookmark_id, query, usage_count. Joined by word, not crossed."""
    asked = contexts.select("query_id", F.explode(F.array_distinct(words("query"))).alias("word"))
    kept = bookmarks.select("bookmark_id", "usage_count", F.explode(F.array_distinct(words("query"))).alias("word"))
    shared = asked.join(kept, "word").groupBy("query_id", "bookmark_id").agg(F.count("*").alias("overlap"), F.max("usage_count").alias("used"))
    scored = shared.withColumn("score", F.col("overlap") + 0.1 * F.coalesce("used", F.lit(0)))
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "bookmark_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "bookmark_id", "score", "rank")


def use_bookmarks(bookmarks: DataFrame, uses: DataFrame) -> DataFrame:
    """Bookmarks with usage_count and last_used advanced by uses (bookmark_id, used_at)."""
    done = uses.groupBy("bookmark_id").agg(F.count("*").alias("_n"), F.max("used_at").alias("_at"))
    joined = bookmarks.join(done, "bookmark_id", "left")
    return joined.withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).withColumn("last_used", F.greatest("last_used", "_at")).drop("_n", "_at")


def with_chunks(memories: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every memory with the number and total length of its chunks, and the ids of the first and last."""
    own = chunks.groupBy("memory_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("chunk_chars"), F.min_by("chunk_id", "chunk_index").alias("first_chunk"), F.max_by("chunk_id", "chunk_index").alias("last_chunk"))
    return memories.join(own, "memory_id", "left").select("memory_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("chunk_chars", F.lit(0)).alias("chunk_chars"), "first_chunk", "last_chunk")
