"""Consolidation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollary.operators import consolidate, vectors
from recollary.plans import base
from recollary.plans.registry import AS_OF, CHUNK, MEM, query

NOW = f"TIMESTAMPTZ '{AS_OF}+00'"
CLUSTER = "nullif(lower(trim(cluster_id)), '')"
AGE = f"((epoch_us({NOW}) - epoch_us(created_at)) / 1e6)"
WEIGHT = "CASE WHEN importance IS NULL OR isnan(importance) THEN 0.5 ELSE importance END"
OLD = f"coalesce({WEIGHT} < 0.3 AND {AGE} >= 30 * 86400, FALSE)"
DUE = f"coalesce(memory_id IS NOT NULL AND memory_type = 'working' AND (epoch_us({NOW}) - epoch_us(coalesce(updated_at, created_at))) / 1e6 >= 8 * 3600, FALSE)"
REPRESENTATIVE = f"""rep AS (SELECT {CLUSTER} AS cluster, memory_id, count(*) OVER (PARTITION BY {CLUSTER}) AS cluster_size,
row_number() OVER (PARTITION BY {CLUSTER} ORDER BY round(0.5 * length(coalesce(content, '')) + 300 * CASE WHEN created_at IS NULL THEN 0.5 ELSE 1.0 / (1 + greatest(0, floor({AGE} / 86400))) END + 200 * coalesce(importance, 0.5), 9) DESC, insert_seq) AS n
FROM mem WHERE {CLUSTER} IS NOT NULL), best AS (SELECT cluster, memory_id, cluster_size FROM rep WHERE n = 1 AND cluster_size >= 2)"""


def cluster():
    return F.nullif(F.lower(F.trim("cluster_id")), F.lit(""))


@query(f"WITH {MEM}, m AS (SELECT memory_id, CASE WHEN {DUE} THEN 'short_term' ELSE memory_type END AS memory_type, CASE WHEN {DUE} THEN {NOW} ELSE updated_at END AS updated_at FROM mem) SELECT * FROM m")
def migrate_tiers(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.migrate(base.memories(spark, d), base.as_of()).select("memory_id", "memory_type", "updated_at")


@query(f"WITH {MEM}, {REPRESENTATIVE} SELECT * FROM best")
def cluster_representative(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.representatives(base.memories(spark, d), cluster(), base.as_of())


@query(f"""WITH {MEM}, {REPRESENTATIVE} SELECT m.memory_id, CASE WHEN b.memory_id IS NOT NULL THEN 'cluster-' || b.memory_id ELSE m.cluster_id END AS cluster_id, coalesce(b.memory_id = m.memory_id, FALSE) AS is_representative,
CASE WHEN b.memory_id IS NOT NULL AND b.memory_id <> m.memory_id THEN TRUE ELSE coalesce(m.is_compressed, FALSE) END AS is_compressed FROM mem m LEFT JOIN best b ON {CLUSTER.replace("cluster_id", "m.cluster_id")} = b.cluster""")
def mark_representatives(spark: SparkSession, d: str) -> DataFrame:
    memories = base.memories(spark, d)
    chosen = consolidate.representatives(memories, cluster(), base.as_of())
    return consolidate.mark(memories, chosen, cluster(), base.as_of()).select("memory_id", "cluster_id", "is_representative", "is_compressed")


@query(f"WITH {MEM} SELECT memory_id FROM mem WHERE {OLD}")
def forget_old(spark: SparkSession, d: str) -> DataFrame:
    return base.memories(spark, d).where(consolidate.forgettable(base.as_of())).select("memory_id")


@query(f"WITH {MEM}, {CHUNK} SELECT chunk_id FROM chk WHERE memory_id IS NULL OR memory_id NOT IN (SELECT memory_id FROM mem WHERE {OLD})")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.forget(base.memories(spark, d), base.chunks(spark, d), base.as_of())[1].select("chunk_id")


def led(source: str) -> str:
    """SQL of greedy leaders over the rows (id, v) of source, one after the other: led(id, leader)."""
    return f"""usable AS (SELECT id, v::DOUBLE[64] AS v FROM {source} WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM usable),
near AS (SELECT b.n, list(a.n) AS before FROM numbered a JOIN numbered b ON a.n < b.n AND array_cosine_similarity(a.v, b.v) >= 0.9 - 1e-12 GROUP BY b.n),
walk(n, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.n + 1, CASE WHEN list_has_any(coalesce(e.before, []), w.leaders) THEN w.leaders ELSE list_append(w.leaders, w.n + 1) END
  FROM walk w LEFT JOIN near e ON e.n = w.n + 1 WHERE w.n < (SELECT count(*) FROM numbered)),
chosen AS (SELECT unnest(leaders) AS n FROM walk WHERE n = (SELECT count(*) FROM numbered)),
followed AS (SELECT e.n, min(c.n) AS lead FROM near e JOIN chosen c ON list_contains(e.before, c.n) WHERE e.n NOT IN (SELECT n FROM chosen) GROUP BY e.n),
led AS (SELECT x.id, coalesce(y.id, x.id) AS leader FROM numbered x LEFT JOIN followed f ON f.n = x.n LEFT JOIN numbered y ON y.n = f.lead)"""


VECTORED = f"""firsts AS (SELECT m.insert_seq AS id, arg_min(c.embedding, (c.chunk_index, c.chunk_id)) AS v FROM mem m JOIN chk c USING (memory_id) WHERE c.embedding IS NOT NULL GROUP BY 1), {led("firsts")}"""


@query(f"""WITH RECURSIVE {MEM}, {CHUNK}, {VECTORED}, grouped AS (SELECT m.*, l.leader FROM mem m LEFT JOIN led l ON l.id = m.insert_seq),
placed AS (SELECT *, count(*) OVER (PARTITION BY leader) AS members, {DUE} AS due, {OLD} AS old, coalesce(migrated_at = {NOW}, FALSE) AS now FROM grouped)
SELECT count(*) FILTER (due OR now) AS migrated, count(DISTINCT leader) AS clusters_created, count(DISTINCT leader) FILTER (members >= 2) AS clusters,
count(*) FILTER (leader IS NOT NULL AND members >= 2) - count(DISTINCT leader) FILTER (members >= 2) AS compressed, count(*) FILTER (old) AS forgotten FROM placed""")
def consolidation_stats(spark: SparkSession, d: str) -> DataFrame:
    memories = base.memories(spark, d, content_length=F.length("content"))
    return consolidate.consolidate(memories, base.chunks(spark, d), base.as_of(), length=F.col("content_length"))[2]


@query(f"WITH {MEM} SELECT coalesce(memory_type, 'unknown') AS memory_type, count(*) AS n, round(avg(coalesce(strength, 0.5)), 6) AS mean_strength FROM mem GROUP BY 1")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = base.memories(spark, d).groupBy(F.coalesce("memory_type", F.lit("unknown")).alias("memory_type"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("strength", F.lit(0.5))), 6).alias("mean_strength"))


@query(f"""WITH {CHUNK}, usable AS (SELECT min(chunk_id) AS id, embedding::DOUBLE[64] AS v FROM chk WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY embedding)
SELECT a.id AS a, b.id AS b, round(array_cosine_similarity(a.v, b.v), 6) AS similarity FROM usable a JOIN usable b ON a.id < b.id AND array_cosine_similarity(a.v, b.v) >= 0.9 - 1e-12""")
def pairwise_similar(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different chunk vectors with a cosine of at least 0.9."""
    return vectors.similar_pairs(base.chunks(spark, d), "chunk_id", "embedding", 64, 0.9).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {CHUNK}, items AS (SELECT insert_seq AS id, embedding AS v FROM chk WHERE embedding IS NOT NULL), {led("items")} SELECT id, leader FROM led""")
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The leader of every usable chunk vector, by insertion order."""
    return consolidate.leader_clusters(base.chunks(spark, d))
