"""Search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollary.functions import scoring
from recollary.functions.text import normalised_name
from recollary.functions.vector import usable
from recollary.operators import bm25, catalog, cross, hybrid, tables, vectors
from recollary.plans import base
from recollary.plans.registry import AS_OF, CHUNK, MEM, SEARCH, query, tokens
from recollary.session import cut, load

USABLE = "len({0}) = 64 AND len(list_filter({0}, lambda x: isfinite(x))) = 64 AND list_max(list_transform({0}, lambda x: abs(x))) > 0"
COSINE = "greatest(-1, least(1, list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])))"

BM25 = f"""
{SEARCH}, {CHUNK}, asked AS (SELECT * FROM search WHERE query_id % 100 = 0),
tok AS (SELECT chunk_id, {tokens("content")} AS w FROM chk),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM tok),
post AS (SELECT chunk_id, term, len(w) AS dl, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens("query")}) AS term FROM asked) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term), stats GROUP BY ALL HAVING score <> 0),
bm_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 30)"""


@query(f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm_top")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.search(base.chunks(spark, d), base.stated(spark, d), hybrid.BM25_K).withColumn("score", F.round("score", 6))


KNN = "SELECT q.vec_id AS query_id, e.vec_id, {cos} AS s FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e {where}"


@query(f"WITH s AS ({KNN.format(cos=COSINE.format('q.embedding', 'e.embedding'), where='')}) SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(rows, asked, 10, "vec_id").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH s AS ({KNN.format(cos=COSINE.format('q.embedding', 'e.embedding'), where='WHERE q.vec_id <> e.vec_id')}) SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 5")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(rows, asked, 5, "vec_id", where=F.col("query_id") != F.col("vec_id")).withColumn("similarity", F.round("similarity", 6))


PROJECT = """pr AS (SELECT regexp_replace(lower(trim(name)), '[\\s_\\-]+', '', 'g') AS n, arg_min(id, (created_at, id)) AS project_id FROM projects WHERE name IS NOT NULL GROUP BY 1)"""

HYBRID = f"""
WITH {BM25}, {MEM}, {PROJECT},
wanted AS (SELECT a.*, CASE WHEN project_name IS NULL THEN NULL ELSE pr.project_id END AS wanted_project FROM asked a LEFT JOIN pr ON regexp_replace(lower(trim(project_name)), '[\\s_\\-]+', '', 'g') = pr.n),
first_chunk AS (SELECT memory_id, embedding FROM chk WHERE chunk_index = 0 AND embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY embedding) = 1),
entries AS (
  SELECT entry_id, m.memory_id, source, created_at, embedding, strength, memory_type, project_id, topic, severity, len(refs) AS n_refs, NULL::INT AS chunk_index FROM mem m LEFT JOIN first_chunk USING (memory_id)
  UNION ALL SELECT chunk_id, memory_id, source, created_at, embedding, NULL, NULL, NULL, NULL, NULL, NULL, chunk_index FROM chk),
qv AS (SELECT query_id, embedding AS qvec FROM bm_top JOIN chk USING (chunk_id) WHERE {USABLE.format("embedding")} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1),
vec AS (SELECT query_id, entry_id, {COSINE.format("embedding", "qvec")} AS similarity FROM entries, qv WHERE {USABLE.format("embedding")}),
vec_top AS (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, entry_id) <= 100),
cand AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.entry_id, b.chunk_id) AS entry_id, coalesce(similarity, 0) AS similarity, coalesce(b.score, 0) AS bm25
  FROM vec_top v FULL JOIN bm_top b ON v.query_id = b.query_id AND v.entry_id = b.chunk_id),
feat AS (SELECT c.*, e.* EXCLUDE (entry_id), w.query, w.top_k, w.wanted_project,
  coalesce(strength, 0.5) AS f1,
  CASE WHEN created_at IS NULL THEN 0.5 ELSE greatest(0, least(1, exp(-greatest(0, epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 3.6e9 / greatest(8.0 * CASE coalesce(memory_type, 'working') WHEN 'working' THEN 1 WHEN 'short_term' THEN 3 WHEN 'long_term' THEN 6 ELSE 4 END, 1)))) END AS f2,
  CASE WHEN coalesce(n_refs, 0) > 0 THEN least(1, ln(1 + n_refs) / ln(11)) ELSE 0 END AS f3,
  CASE WHEN bm25 <= 0 THEN 0 ELSE 1 / (1 + exp(-0.1 * bm25)) END AS f4,
  CASE WHEN source = 'session' THEN -0.05 ELSE 0 END
  + CASE WHEN coalesce(topic, '') = '' THEN 0 WHEN contains(lower(query), lower(topic)) THEN 0.05 ELSE -0.01 END
  + CASE WHEN lower(severity) = 'high' AND regexp_matches(lower(query), 'incident|inc|bug|sev|pager') THEN 0.05 ELSE 0 END
  + CASE WHEN wanted_project IS NULL THEN 0 WHEN coalesce(project_id = wanted_project, FALSE) THEN 0.03 ELSE -0.05 END AS f6
  FROM cand c JOIN entries e USING (entry_id) JOIN wanted w USING (query_id)),
scored AS (SELECT *, greatest(0, least(1, 0.3 * f1 + 0.2 * f2 + 0.1 * f3 + 0.2 * f4 + 0.2 * similarity + f6)) AS score FROM feat),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entry_id) AS r, coalesce(memory_id, entry_id) AS grp,
  CASE coalesce(memory_type, 'working') WHEN 'working' THEN 0 WHEN 'short_term' THEN 1 WHEN 'long_term' THEN 2 ELSE 3 END + CASE WHEN chunk_index IS NOT NULL THEN 1 ELSE 0 END AS prio FROM scored),
slots AS (SELECT *, min(r) OVER (PARTITION BY query_id, grp) AS slot FROM ranked),
won AS (SELECT * FROM slots QUALIFY row_number() OVER (PARTITION BY query_id, grp ORDER BY prio, r) = 1),
cutoff AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS position FROM won QUALIFY position <= coalesce(top_k, 10)),
flagged AS (SELECT *, bool_or(chunk_index IS NULL) OVER (PARTITION BY query_id) AS some_entry FROM cutoff)"""


def leaves(spark: SparkSession, d: str, stated: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """entries, queries, vector hits and BM25 hits of the stated queries (base.stated, unless others are given).

    Without an embedding model a query takes the embedding of its best BM25 chunk."""
    chunks, stated = base.chunks(spark, d), base.stated(spark, d) if stated is None else stated
    entries = tables.entries(base.memories(spark, d), chunks)
    hits = cut(bm25.search(chunks, stated, hybrid.BM25_K))
    best = Window.partitionBy("query_id").orderBy("rank")
    known = hits.join(chunks.where(usable("embedding", 64)).select("chunk_id", "embedding"), "chunk_id")
    queries = cut(known.withColumn("n", F.row_number().over(best)).where("n = 1").select("query_id", F.col("embedding").alias("query_vector")))
    near = vectors.nearest(entries.where(F.size("embedding") == 64), queries, hybrid.VECTOR_K, "entry_id")
    names = catalog.resolve_projects(stated, load(spark, d, "projects"))
    wanted = names.withColumn("wanted_project", F.when(F.col("project_name").isNotNull(), F.col("project_id"))).select("query_id", "query", "top_k", "wanted_project")
    return entries, wanted, near, hits.withColumnRenamed("chunk_id", "entry_id")


@query(HYBRID + " SELECT query_id, entry_id, memory_id, round(score, 6) AS score, position FROM flagged WHERE NOT some_entry OR chunk_index IS NULL")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.hybrid(*leaves(spark, d), base.as_of()).withColumn("score", F.round("score", 6))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search for every search of the runs table."""
    return hybrid.hybrid(*leaves(spark, d, base.searches(spark, d)), base.as_of()).withColumn("score", F.round("score", 6))


@query(HYBRID.replace("FROM cand c JOIN entries e USING (entry_id) JOIN wanted w USING (query_id)", "FROM cand c JOIN entries e USING (entry_id) JOIN wanted w USING (query_id) WHERE wanted_project IS NULL OR coalesce(project_id = wanted_project, FALSE)") + " SELECT query_id, entry_id, memory_id, round(score, 6) AS score, position FROM flagged WHERE NOT some_entry OR chunk_index IS NULL")
def filtered_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.hybrid(*leaves(spark, d), base.as_of(), strict_filters=True).withColumn("score", F.round("score", 6))


@query(HYBRID + ", heur AS (SELECT query_id, entry_id, round(greatest(0, least(1, 0.4 * similarity + 0.3 * f4 + 0.2 * f6 + 0.1 * f2)), 6) AS relevance FROM scored) SELECT * FROM heur")
def heuristic_relevance(spark: SparkSession, d: str) -> DataFrame:
    entries, queries, near, hits = leaves(spark, d)
    scored = hybrid.rerank(hybrid.merge(near, hits).join(entries.drop("embedding"), "entry_id").join(queries, "query_id"), base.as_of())
    score = scoring.heuristic_relevance(F.col("f_vector"), F.col("f_bm25"), F.col("f_metadata"), F.col("f_recency"))
    return scored.select("query_id", "entry_id", F.round(score, 6).alias("relevance"))


@query()
def cross_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid results after the second stage, scored by the formula that stands in for a model."""
    entries, queries, near, hits = leaves(spark, d)
    scored = hybrid.rerank(hybrid.merge(near, hits).join(entries.drop("embedding"), "entry_id").join(queries, "query_id"), base.as_of())
    results = hybrid.deduplicate(scored, F.coalesce("top_k", F.lit(10)))
    formula = scoring.heuristic_relevance(F.col("f_vector"), F.col("f_bm25"), F.col("f_metadata"), F.col("f_recency"))
    return cross.cross_rerank(results, formula).select("query_id", "entry_id", "position", "new_position", F.round("cross_score", 6).alias("cross_score"))


@query(f"""WITH {MEM} SELECT project_id, memory_id, entry_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC NULLS LAST, entry_id) AS place
FROM mem WHERE project_id IS NOT NULL QUALIFY place <= 100""")
def pool_load(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.pool(tables.entries(base.memories(spark, d), base.chunks(spark, d)))


@query(f"""WITH {MEM} SELECT memory_id, created_at, CASE WHEN length(summary) > 200 THEN substring(summary, 1, 200) || '...' ELSE summary END AS summary
FROM mem ORDER BY created_at DESC NULLS LAST, memory_id LIMIT 10""")
def list_recent(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_recent(base.memories(spark, d))


@query(f"""WITH {MEM}, {CHUNK} SELECT m.memory_id, count(c.chunk_id) AS n_chunks, coalesce(sum(length(c.content)), 0)::BIGINT AS chunk_chars,
arg_min(c.chunk_id, c.chunk_index) AS first_chunk, arg_max(c.chunk_id, c.chunk_index) AS last_chunk FROM mem m LEFT JOIN chk c ON m.memory_id = c.memory_id GROUP BY 1""")
def memory_chunks(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_chunks(base.memories(spark, d), base.chunks(spark, d))


@query(f"WITH {MEM}, {CHUNK} SELECT chunk_id, memory_id FROM chk c WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.memory_id = c.memory_id)")
def orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tables.delete(base.chunks(spark, d), base.memories(spark, d), "memory_id").select("chunk_id", "memory_id")


@query(f"""WITH {MEM} SELECT p.id, p.name, p.memory_count AS stored, count(m.memory_id) AS counted, coalesce(p.memory_count, 0) - count(m.memory_id) AS drift
FROM projects p LEFT JOIN mem m ON m.project_id = p.id GROUP BY p.id, p.name, p.memory_count""")
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.project_counts(load(spark, d, "projects"), base.memories(spark, d))


@query("SELECT id, name FROM projects WHERE list_has_all(list_transform(coalesce(tags, []), lambda t: lower(t)), ['health', 'session'])")
def tag_all_of(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_all_tags(load(spark, d, "projects"), ["Health", "session"]).select("id", "name")


@query(f"""WITH {SEARCH}, {PROJECT} SELECT query_id, project_name, coalesce(p.id, pr.project_id) AS project_id FROM search s LEFT JOIN projects p ON p.id = s.project_name
LEFT JOIN pr ON regexp_replace(lower(trim(project_name)), '[\\s_\\-]+', '', 'g') = pr.n WHERE project_name IS NOT NULL""")
def project_resolution(spark: SparkSession, d: str) -> DataFrame:
    named = base.searches(spark, d).where("project_name is not null").select("query_id", "project_name")
    return catalog.resolve_projects(named, load(spark, d, "projects"))


BOOKMARKS = "bm AS (SELECT id AS bookmark_id, concat_ws(' ', name, description) AS text, memory_count AS used FROM projects)"


@query(f"""WITH {SEARCH}, {BOOKMARKS}, qw AS (SELECT DISTINCT query_id, unnest({tokens("query")}) AS word FROM search), bw AS (SELECT DISTINCT bookmark_id, used, unnest({tokens("text")}) AS word FROM bm),
s AS (SELECT query_id, bookmark_id, (count(*) + 0.1 * coalesce(max(used), 0))::DOUBLE AS score FROM qw JOIN bw USING (word) GROUP BY ALL)
SELECT query_id, bookmark_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, bookmark_id) AS rank FROM s QUALIFY rank <= 3""")
def bookmark_recommend(spark: SparkSession, d: str) -> DataFrame:
    saved = load(spark, d, "projects").select(F.col("id").alias("bookmark_id"), F.concat_ws(" ", "name", "description").alias("query"), F.col("memory_count").alias("usage_count"))
    return catalog.recommend(base.searches(spark, d), saved).withColumn("score", F.round("score", 6).cast("double"))


@query(f"""WITH {SEARCH}, {PROJECT} SELECT regexp_replace(lower(trim(project_name)), '[\\s_\\-]+', '', 'g') AS name, count(*) AS n FROM search WHERE project_name IS NOT NULL GROUP BY 1""")
def project_names_asked(spark: SparkSession, d: str) -> DataFrame:
    return base.searches(spark, d).where("project_name is not null").groupBy(normalised_name("project_name").alias("name")).agg(F.count("*").alias("n"))


@query("""WITH first AS (SELECT DISTINCT ON (memory_id) memory_id FROM memories ORDER BY memory_id, ingested_at)
SELECT count(*) AS delivered, count(DISTINCT memory_id) AS kept, count(*) - count(DISTINCT memory_id) AS skipped FROM memories""")
def import_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Importing every delivery into an empty store in order: first ones are kept, later ones skipped."""
    rows = load(spark, d, "memories").select("memory_id", "content", "ingested_at", "insert_seq")
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy("ingested_at", "insert_seq"))
    placed = rows.withColumn("place", place)
    store = tables.import_rows(placed.where("place = 1").drop("place"), placed.where("place > 1").drop("place"), "memory_id", "content")
    total = rows.agg(F.count("*").alias("delivered"))
    return store.agg(F.count("*").alias("kept")).crossJoin(total).select("delivered", "kept", (F.col("delivered") - F.col("kept")).alias("skipped"))
