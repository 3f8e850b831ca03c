"""Table operations by key: newest row, upsert, update, delete, import, and the entry view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first in the given order. Rows with a null key form one group."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key; the others are added."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null values of changes overwrite the columns of the same key; maps are merged key by key."""
    names = [c for c in changes.columns if c != key and c in table.columns]
    marked = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = table.join(marked, key, "left")
    kinds = dict(table.dtypes)

    def merged(c: str) -> Column:
        new = F.col(f"_new_{c}")
        if not kinds[c].startswith("map"):
            return F.coalesce(new, F.col(c))
        kept = F.map_filter(F.coalesce(c, F.create_map().cast(kinds[c])), lambda k, _: ~F.map_contains_key(new, k))
        return F.when(new.isNull(), F.col(c)).otherwise(F.map_concat(kept, new))

    return joined.select(*[merged(c).alias(c) if c in names else F.col(c) for c in table.columns])


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def import_rows(table: DataFrame, rows: DataFrame, key: str, content: str, force: bool = False) -> DataFrame:
    """The table with imported rows: those without key or content are left out, known keys only with force."""
    good = rows.where(F.col(key).isNotNull() & (F.coalesce(F.col(content), F.lit("")) != ""))
    return upsert(table, good, key) if force else table.unionByName(delete(good, table, key), allowMissingColumns=True)


def matching(table: DataFrame, filters: dict[str, object]) -> Column:
    """Conjunction over the table's columns: equality; a list column matches by membership, or as a whole if a list
    is given; {"$ne": value} by inequality, which a null passes. Other columns than a list never equal a list."""
    kinds = {f.name: f.dataType for f in table.schema.fields}

    def one(name: str, wanted: object) -> Column:
        listed = isinstance(kinds[name], T.ArrayType)
        if isinstance(wanted, dict):
            return ~F.coalesce(one(name, wanted["$ne"]), F.lit(False))
        if isinstance(wanted, list):
            return F.col(name) == F.array(*map(F.lit, wanted)).cast(kinds[name]) if listed else F.lit(False)
        return F.array_contains(name, F.lit(wanted)) if listed else F.col(name) == F.lit(wanted)

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in filters.items()], F.lit(True))


def prepared_filters(filters: dict[str, object] | None = None, attributes: dict[str, object] | None = None, with_summaries: bool = False) -> dict[str, object] | None:
    """The user's filters, attributes that they do not set, and no session summaries unless asked for; None if empty."""
    made = {**(attributes or {}), **(filters or {})}
    if not with_summaries:
        made.setdefault("is_session_summary", {"$ne": True})
    return made or None


def entries(memories: DataFrame, chunks: DataFrame, inherit: bool = False) -> DataFrame:
    """Memory entries and chunks as one collection.

    Chunks carry no strength, tier or project of their own unless inherit is set; a memory entry takes the
    embedding of its first chunk."""
    first = chunks.where("chunk_index = 0").select("memory_id", "embedding")
    own = memories.join(newest(first.where("embedding is not null"), "memory_id", F.col("embedding")), "memory_id", "left")
    kept = ["memory_id", "source", "created_at"]
    as_entry = own.select("entry_id", *kept, "embedding", "strength", "memory_type", "project_id", "topic", "severity", F.size("refs").alias("n_refs"), F.lit(None).cast("int").alias("chunk_index"))
    nothing = {"strength": "double", "memory_type": "string", "project_id": "string", "topic": "string", "severity": "string", "n_refs": "int"}
    as_chunk = chunks.select(F.col("chunk_id").alias("entry_id"), *kept, "embedding", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "chunk_index")
    if inherit:
        extra = memories.select("memory_id", "strength", "memory_type", "project_id", "topic", "severity", F.size("refs").alias("n_refs"))
        as_chunk = as_chunk.drop(*nothing).join(extra, "memory_id", "left").select(as_entry.columns)
    return as_entry.unionByName(as_chunk)
