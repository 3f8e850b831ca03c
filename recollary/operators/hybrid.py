"""Hybrid retrieval: vector and BM25 candidates merged, reranked by six features, deduplicated, cut."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollary.functions import scoring

VECTOR_K, BM25_K = 100, 30


def merge(vector_hits: DataFrame, bm25_hits: DataFrame) -> DataFrame:
    """query_id, entry_id, similarity, bm25: full outer union of the two candidate lists; 0 where absent."""
    v = vector_hits.select("query_id", "entry_id", "similarity")
    b = bm25_hits.select("query_id", "entry_id", F.col("score").alias("bm25"))
    return v.join(b, ["query_id", "entry_id"], "full_outer").na.fill(0.0, ["similarity", "bm25"])


def rerank(candidates: DataFrame, as_of: Column, hours: float = 8.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds the six features and score. candidates: merge() joined with entries and queries (query,
    wanted_project)."""
    features = {
        "strength": F.coalesce("strength", F.lit(0.5)),
        "recency": scoring.recency("created_at", "memory_type", as_of, hours),
        "refs": scoring.refs_reliability("n_refs"),
        "bm25": scoring.normalised_bm25("bm25"),
        "vector": F.col("similarity"),
        "metadata": scoring.metadata_bonus(F.col("query"), F.col("source"), F.col("topic"), F.col("severity"), F.col("project_id"), F.col("wanted_project")),
    }
    return candidates.withColumns({f"f_{k}": v for k, v in features.items()}).withColumn("score", scoring.combined({k: F.col(f"f_{k}") for k in features}, weights))


def priority() -> Column:
    """Lower takes a slot: tier 0 to 2 (unknown 3), one more for a chunk."""
    kind = F.coalesce("memory_type", F.lit("working"))
    tier = F.when(kind == "working", 0).when(kind == "short_term", 1).when(kind == "long_term", 2).otherwise(3)
    return tier + F.when(F.col("chunk_index").isNotNull(), 1).otherwise(0)


def deduplicate(scored: DataFrame, k: Column) -> DataFrame:
    """One entry per memory and query, in the slot of the memory's best entry; then k, then entries first.

    The entry of lowest priority number fills the slot, the better ranked among equals. Holds where no two
    memories share project, topic, source and creation time (see deduplicate_general). If any memory entry
    is among the k, chunks are dropped, so fewer than k may remain."""
    by_query = Window.partitionBy("query_id")
    ranked = scored.withColumn("r", F.row_number().over(by_query.orderBy(F.round("score", 9).desc(), "entry_id")))
    group = F.coalesce("memory_id", "entry_id")
    slots = ranked.withColumn("priority", priority()).withColumn("group", group)
    won = slots.withColumn("slot", F.min("r").over(Window.partitionBy("query_id", "group")))
    won = won.withColumn("w", F.row_number().over(Window.partitionBy("query_id", "group").orderBy("priority", "r"))).where("w = 1")
    cut = won.withColumn("position", F.row_number().over(by_query.orderBy("slot"))).where(F.col("position") <= k)
    some = F.max(F.col("chunk_index").isNull()).over(by_query)
    return cut.withColumn("some_entry", some).where(~F.col("some_entry") | F.col("chunk_index").isNull()).drop("r", "w", "group", "slot", "some_entry")


def deduplicate_general(scored: DataFrame, default_k: int = 10) -> DataFrame:
    """query_id, entry_id, score, position by the two-key slot rule, for lists in which different memories
    share project, topic, source and creation time.

    Folds each query's candidates, of which there are at most VECTOR_K + BM25_K, in score order."""
    rows = scored.withColumn("priority", priority()).select(
        "query_id", "entry_id", "memory_id", "chunk_index", "score", "priority", F.coalesce("top_k", F.lit(default_k)).alias("k"),
        F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project_id", "topic", "source", "created_at")]).alias("key"),
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(rounded=pdf["score"].round(9)).sort_values(["rounded", "entry_id"], ascending=[False, True], kind="stable")
        chosen, by_memory, by_key = [], {}, {}
        for row in pdf.itertuples(index=False):
            key = row.key if row.key.strip("\u0001") else None
            slot = by_memory.get(row.memory_id) if row.memory_id is not None else None
            slot = by_key.get(key) if slot is None and key is not None else slot
            if slot is None:
                if row.memory_id is not None:
                    by_memory[row.memory_id] = len(chosen)
                if key is not None:
                    by_key[key] = len(chosen)
                chosen.append(row)
            else:
                held = chosen[slot]
                if row.priority < held.priority or (row.priority == held.priority and row.score > held.score):
                    chosen[slot] = row
        unique = list({row.entry_id: row for row in reversed(chosen)}.values())[::-1][: int(pdf["k"].iloc[0])]
        if any(pd.isna(row.chunk_index) for row in unique):
            kept = [(i, row) for i, row in enumerate(unique, 1) if pd.isna(row.chunk_index)]
        else:
            kept = list(enumerate(unique, 1))
        return pd.DataFrame([(r.query_id, r.entry_id, r.score, i) for i, r in kept], columns=["query_id", "entry_id", "score", "position"])

    kind = scored.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(fold, f"query_id {kind}, entry_id string, score double, position int")


def hybrid(entries: DataFrame, queries: DataFrame, vector_hits: DataFrame, bm25_hits: DataFrame, as_of: Column, default_k: int = 10, strict_filters: bool = False, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, entry_id, memory_id, score, position for every query.

    queries: query_id, query, top_k, wanted_project. The BM25 leaf ignores filters, as wrong projects only
    lose a little score; strict_filters drops them altogether."""
    found = merge(vector_hits, bm25_hits).join(entries.drop("embedding"), "entry_id").join(queries, "query_id")
    if strict_filters:
        found = found.where(F.col("wanted_project").isNull() | F.coalesce(F.col("project_id") == F.col("wanted_project"), F.lit(False)))
    scored = rerank(found, as_of, weights=weights)
    return deduplicate(scored, F.coalesce("top_k", F.lit(default_k))).select("query_id", "entry_id", "memory_id", "score", "position")


def pool(entries: DataFrame, size: int = 100) -> DataFrame:
    """A project's newest memory entries, at most size of them: project_id, memory_id, entry_id, place."""
    newest = Window.partitionBy("project_id").orderBy(F.col("created_at").desc_nulls_last(), "entry_id")
    own = entries.where(F.col("chunk_index").isNull() & F.col("project_id").isNotNull())
    return own.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= size).select("project_id", "memory_id", "entry_id", "place")


def project_search(pooled: DataFrame, full: DataFrame, queries: DataFrame, least_score: float = 0.3, default_k: int = 10) -> DataFrame:
    """Per query the pool's results if there are k of them and all reach least_score, else the full ones."""
    counts = pooled.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    judged = queries.join(counts, "query_id", "left").select("query_id", ((F.coalesce("n", F.lit(0)) >= F.coalesce("top_k", F.lit(default_k))) & (F.coalesce("low", F.lit(0.0)) >= least_score)).alias("enough"))
    return pooled.join(judged.where("enough"), "query_id").drop("enough").unionByName(full.join(judged.where("not enough"), "query_id").drop("enough"))
