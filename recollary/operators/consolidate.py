"""Batch life cycle of memories: tier migration, leader clustering, representatives, forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollary.functions.scoring import seconds
from recollary.operators.vectors import distinct_vectors, members, pairs_of, printed
from recollary.session import cut


def migrate(memories: DataFrame, as_of: Column, hours: float = 8.0) -> DataFrame:
    """Working memories last touched at least hours ago become short_term, stamped with as_of."""
    touched = F.coalesce("updated_at", "created_at")
    due = F.col("memory_id").isNotNull() & (F.col("memory_type") == "working") & (seconds(as_of, touched) >= hours * 3600)
    due = F.coalesce(due, F.lit(False))
    return memories.withColumns({
        "updated_at": F.when(due, as_of).otherwise(F.col("updated_at")),
        "migrated_at": F.when(due, as_of).otherwise(F.col("migrated_at")),
        "memory_type": F.when(due, "short_term").otherwise(F.col("memory_type")),
    })


def leaders(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, leader of every id in edges (a < b, both in insertion order): the greedy star clustering.

    An id is a leader if no leader before it is its neighbour; others follow their first leader. Each round
    decides all ids whose earlier neighbours allow it; lineage is cut by a checkpoint in every round."""
    edges = cut(edges.select(F.col("a").alias("earlier"), F.col("b").alias("later")))
    ids = edges.select(F.col("earlier").alias("id")).union(edges.select("later")).distinct()
    state = cut(ids.withColumn("state", F.lit("open")))
    for _ in range(rounds):
        before = edges.join(state, edges["earlier"] == state["id"]).groupBy("later").agg(F.max((F.col("state") == "leader").cast("int")).alias("led"), F.max((F.col("state") == "open").cast("int")).alias("waits"))
        joined = state.join(before, state["id"] == before["later"], "left").select("id", "state", "led", "waits")
        new = F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("led", F.lit(0)) == 1, "follower").when(F.coalesce("waits", F.lit(0)) == 1, "open").otherwise("leader")
        state = cut(joined.select("id", new.alias("state")))
        if state.where("state = 'open'").isEmpty():
            break
    else:
        raise RuntimeError("leader clustering did not end; raise rounds")
    led = edges.join(state.where("state = 'leader'"), edges["earlier"] == F.col("id")).groupBy("later").agg(F.min("earlier").alias("leader"))
    return state.join(led, state["id"] == led["later"], "left").select("id", F.when(F.col("state") == "leader", F.col("id")).otherwise(F.col("leader")).alias("leader"))


def leader_clusters(items: DataFrame, order: str = "insert_seq", vector: str = "embedding", size: int = 64, threshold: float = 0.9, unique: bool = False) -> DataFrame:
    """id, leader (both by the order column, a unique number) of every usable vector; alone, it leads itself.

    Equal vectors are compared once and share their leader. Nulls and unusable vectors have no row.
    unique: each number is known to occur once (see members)."""
    usable = cut(printed(members(items, order, vector, size, unique)))
    distinct = distinct_vectors(usable)
    copies = usable.select("id", "print").join(distinct.select("print", F.col("id").alias("first")), "print")
    led = leaders(pairs_of(distinct, size, threshold))
    return copies.join(led.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("leader", "first").alias("leader"))


def clusters(memories: DataFrame, chunks: DataFrame, size: int = 64, threshold: float = 0.9) -> DataFrame:
    """insert_seq, cluster (the insert_seq of the leader) of memories, by the vectors of their first chunks.

    A memory without a usable vector has no row; alone with one, it is its own."""
    first = chunks.where(F.col("embedding").isNotNull()).groupBy("memory_id").agg(F.min_by("embedding", F.struct("chunk_index", "chunk_id")).alias("_v"))
    placed = memories.select("memory_id", "insert_seq").dropDuplicates(["insert_seq"]).join(first, "memory_id")
    led = leader_clusters(placed, "insert_seq", "_v", size, threshold, unique=True)
    return led.select(F.col("id").alias("insert_seq"), F.col("leader").cast("string").alias("cluster"))


def score_of_representative(as_of: Column, length: Column | None = None) -> Column:
    """0.5 x content length + 300 x recency by days + 200 x importance."""
    days = F.floor(seconds(as_of, "created_at") / 86400)
    fresh = F.when(F.col("created_at").isNull(), 0.5).otherwise(1 / (1 + F.greatest(F.lit(0), days)))
    length = F.length("content") if length is None else length
    return 0.5 * F.coalesce(length, F.lit(0)) + 300 * fresh + 200 * F.coalesce("importance", F.lit(0.5))


def representatives(memories: DataFrame, cluster: Column, as_of: Column, least: int = 2, length: Column | None = None) -> DataFrame:
    """cluster, memory_id (the representative), cluster_size, of clusters of at least `least` memories.

    By partial aggregation: no cluster is collected, whatever its size. Ties go to the first inserted.
    length: of the content, where a column has it already."""
    best = F.max(F.struct(F.round(score_of_representative(as_of, length), 9).alias("s"), (-F.col("insert_seq")).alias("o"), "memory_id"))
    rows = memories.withColumn("cluster", cluster).where("cluster is not null")
    return rows.groupBy("cluster").agg(best.alias("b"), F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= least).select("cluster", "b.memory_id", "cluster_size")


def mark(memories: DataFrame, chosen: DataFrame, cluster: Column, as_of: Column) -> DataFrame:
    """Memories with cluster_id, cluster_size, is_representative set; the other members are flagged compressed."""
    known = chosen.select("cluster", F.col("memory_id").alias("_best"), F.col("cluster_size").alias("_size"))
    joined = memories.withColumn("cluster", cluster).join(known, "cluster", "left")
    inside, best = F.col("_best").isNotNull(), F.col("_best") == F.col("memory_id")
    other = inside & ~best
    return joined.withColumns({
        "cluster_id": F.when(inside, F.concat(F.lit("cluster-"), "_best")).otherwise(F.col("cluster_id")),
        "cluster_size": F.when(inside, F.col("_size").cast("int")).otherwise(F.col("cluster_size")),
        "is_representative": F.coalesce(best, F.lit(False)),
        "is_compressed": F.when(other, True).otherwise(F.coalesce("is_compressed", F.lit(False))),
        "compressed_at": F.when(other, as_of).otherwise(F.col("compressed_at")),
    }).drop("cluster", "_best", "_size")


def forgettable(as_of: Column, least: float = 0.3, days: float = 30) -> Column:
    """Unimportant and old. An unknown or non-finite importance is 0.5; an unknown age is not old."""
    weight = F.when(F.col("importance").isNull() | F.isnan("importance"), 0.5).otherwise(F.col("importance"))
    return F.coalesce((weight < least) & (seconds(as_of, "created_at") >= days * 86400), F.lit(False))


def forget(memories: DataFrame, chunks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Memories that stay, and chunks without those of the forgotten ones."""
    gone = memories.where(forgettable(as_of)).select("memory_id").distinct()
    return memories.where(~forgettable(as_of)), chunks.join(gone, "memory_id", "left_anti")


#: what clusters, representatives, marks and counts need of a memory
NEEDED = ["memory_id", "insert_seq", "created_at", "importance", "migrated_at", "cluster_id", "cluster_size", "is_compressed", "compressed_at"]


def consolidate(memories: DataFrame, chunks: DataFrame, as_of: Column, cluster: Column | None = None, size: int = 64, threshold: float = 0.9, length: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """migrate, cluster, mark representatives, compress, forget: the new memories and chunks, and a row of counts.

    Clusters are those of leaders by similarity, unless a column names them. clusters_created counts those of
    one memory too; only clusters of two or more get a representative. Everything is decided and counted
    without the contents, of which only the length counts (see representatives); the memories are marked when
    they are read."""
    moved = migrate(memories, as_of)
    length = F.length("content") if length is None else length
    own = F.col("cluster")
    slim = cut(moved.select(*NEEDED, length.alias("_length"), *([] if cluster is None else [cluster.alias("cluster")])))
    if cluster is None:
        led = cut(clusters(slim, chunks, size, threshold))
        slim, grouped = slim.join(led, "insert_seq", "left"), moved.join(led, "insert_seq", "left")
    else:
        grouped = moved.withColumn("cluster", cluster)
    chosen = cut(representatives(slim, own, as_of, length=F.col("_length")))
    created = slim.agg(F.count_distinct("cluster").alias("clusters_created"))
    stats = mark(slim, chosen, own, as_of).crossJoin(F.broadcast(created)).agg(
        F.count_if((F.col("migrated_at") == as_of)).alias("migrated"),
        F.coalesce(F.max("clusters_created"), F.lit(0)).alias("clusters_created"),
        F.count_if("is_representative").alias("clusters"),
        F.count_if(F.col("compressed_at") == as_of).alias("compressed"),
        F.count_if(forgettable(as_of)).alias("forgotten"),
    )
    kept, rest = forget(mark(grouped, chosen, own, as_of), chunks, as_of)
    return kept, rest, stats
