"""Text, scoring and ingestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollary.functions import scoring
from recollary.functions import text as T
from recollary.functions.attributes import DOC_TYPES, SEVERITIES, TOPICS, query_attributes
from recollary.operators import ingest
from recollary.plans import base
from recollary.plans.registry import AS_OF, CHUNK, EVENT, MEM, SEARCH, WS, query
from recollary.session import load

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def keywords_sql(text: str, n: int) -> str:
    bare = rf"regexp_replace(lower(trim(coalesce({text}, ''))), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g')"
    found = rf"list_distinct(list_filter(regexp_split_to_array({bare}, '[\s\-_]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})))"
    return f"list_transform(list_sort(list_transform({found}, lambda w: {{'l': -length(w), 'w': w}})), lambda s: s.w)[1:{n}]"


@query(f"WITH {SEARCH} SELECT query_id, array_to_string(list_sort({keywords_sql('query', 3)}), '+') AS signature FROM search")
def keyword_signature(spark: SparkSession, d: str) -> DataFrame:
    return base.searches(spark, d).select("query_id", T.keyword_signature("query").alias("signature"))


def lookup_sql(table: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(q, '{k}') THEN '{v}'" for k, v in table.items()) + " END"


@query(rf"""WITH {SEARCH}, low AS (SELECT query_id, lower(query) AS q, query FROM search), n AS (SELECT *, regexp_matches(q, 'inc[-_ ]?\d+') AS number FROM low)
SELECT query_id, coalesce({lookup_sql(TOPICS)}, CASE WHEN number THEN 'incident' END) AS topic, coalesce({lookup_sql(DOC_TYPES)}, CASE WHEN number THEN 'incident' END) AS doc_type,
coalesce({lookup_sql(SEVERITIES)}, CASE WHEN number THEN 'high' END) AS severity, array_to_string({keywords_sql("query", 10)}, ' ') AS keywords FROM n""")
def attributes_of_queries(spark: SparkSession, d: str) -> DataFrame:
    found = base.searches(spark, d).select("query_id", query_attributes("query").alias("a"))
    return found.select("query_id", "a.topic", "a.doc_type", "a.severity", F.array_join("a.keywords", " ").alias("keywords"))


@query("SELECT CASE WHEN regexp_matches(coalesce(text, ''), '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]') THEN 'ja' WHEN regexp_matches(coalesce(text, ''), '[áéíóúñ¿¡]') THEN 'es' ELSE 'en' END AS language, count(*) AS n FROM documents GROUP BY 1")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(T.language_simple("text").alias("language")).agg(F.count("*").alias("n"))


@query(f"""WITH {MEM}, c AS (SELECT lower(trim(coalesce(content, ''))) AS t FROM mem), k AS (SELECT CASE
WHEN regexp_matches(regexp_extract(t, '^(\\S*)', 1), 'incident') THEN 'Incident' WHEN regexp_matches(regexp_extract(t, '^(\\S*)', 1), 'snippet') THEN 'Snippet'
WHEN regexp_matches(regexp_extract(t, '^(\\S*)', 1), 'decision') THEN 'Decision' WHEN regexp_matches(regexp_extract(t, '^(\\S*)', 1), 'process') THEN 'Process'
WHEN regexp_matches(t, 'bug|error|fail|exception|crash') THEN 'Incident' WHEN regexp_matches(t, 'code|example|snippet|implementation') THEN 'Snippet'
WHEN regexp_matches(t, 'choose|decision|trade|compare') THEN 'Decision' ELSE 'Process' END AS schema_type FROM c)
SELECT v.schema_type, count(k.schema_type) AS n FROM (VALUES ('Incident'), ('Snippet'), ('Decision'), ('Process')) v(schema_type) LEFT JOIN k USING (schema_type) GROUP BY 1""")
def schema_classify(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([("Incident",), ("Snippet",), ("Decision",), ("Process",)], "schema_type string")
    counted = base.memories(spark, d).groupBy(T.schema_class("content").alias("schema_type")).agg(F.count("*").alias("n"))
    return kinds.join(counted, "schema_type", "left").na.fill(0, ["n"])


TOKENS = f"floor(len(list_filter(regexp_split_to_array(coalesce(content, ''), '{WS}'), lambda w: w <> '')) / 0.75)::INT"


@query(f"WITH {CHUNK} SELECT chunk_id, {TOKENS} AS counted, coalesce(tokens, -1) <> {TOKENS} AS stale FROM chk")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = T.count_tokens("content")
    return base.chunks(spark, d).select("chunk_id", counted.alias("counted"), (F.coalesce("tokens", F.lit(-1)) != counted).alias("stale"))


@query(f"""WITH {CHUNK}, t AS (SELECT chunk_id, coalesce(tokens, 0)::DOUBLE AS t FROM chk) SELECT chunk_id, round(CASE WHEN t BETWEEN 256 AND 384 THEN greatest(0.95, 1 - 0.05 * abs(t - 320) / 128)
WHEN t < 256 THEN greatest(0.5, least(0.95, 0.5 + 0.45 * t / 256)) ELSE greatest(0.5, least(0.95, 0.95 - 0.15 * ln(1 + (t - 384) / 384))) END, 6) AS salience FROM t""")
def salience_weight(spark: SparkSession, d: str) -> DataFrame:
    return base.chunks(spark, d).select("chunk_id", F.round(scoring.salience("tokens"), 6).alias("salience"))


@query(f"WITH {EVENT} SELECT event_id, sha1(concat_ws('-', coalesce(session_id, ''), coalesce(role, ''), coalesce(command, output, ''))) AS message_key FROM ev")
def message_keys(spark: SparkSession, d: str) -> DataFrame:
    return base.events(spark, d).select("event_id", T.message_key("session_id", "role", F.coalesce("command", "output", F.lit(""))).alias("message_key"))


PAIR = r"(?s)^\s*(?:\*\*User:\*\*|User:)\s*(.*?)\s*\n+(?:\*\*Assistant:\*\*|Assistant:)\s*(.*)$"


@query(rf"""WITH {MEM}, p AS (SELECT memory_id, regexp_extract(content, '{PAIR}', 1) AS u, regexp_extract(content, '{PAIR}', 2) AS a FROM mem)
SELECT memory_id, md5(u) AS user_md5, md5(a) AS assistant_md5 FROM p WHERE u <> '' AND a <> ''""")
def conversation_pairs(spark: SparkSession, d: str) -> DataFrame:
    split = base.memories(spark, d).select("memory_id", T.conversation("content").alias("c")).where("c is not null")
    return split.select("memory_id", F.md5("c.user").alias("user_md5"), F.md5("c.assistant").alias("assistant_md5"))


@query()
def conversation_memories(spark: SparkSession, d: str) -> DataFrame:
    """The conversations of all memories ingested anew and cut into chunks."""
    split = base.memories(spark, d).withColumn("c", T.conversation("content")).where("c is not null")
    made, _ = ingest.remember(split.select("c.user", "c.assistant", "source", "created_at", "project_id", "refs", "topic", "doc_type"), base.as_of())
    return ingest.chunks(made)


@query(rf"""WITH {MEM}, k AS (SELECT memory_id, {keywords_sql("content", 5)} AS k, trim(coalesce(summary, '')) AS s, trim(regexp_extract(coalesce(content, ''), '(?m)^#{{1,3}}[ \t]+(.+)$', 1)) AS h FROM mem)
SELECT memory_id, concat_ws(' | ', CASE WHEN s <> '' THEN s END, CASE WHEN len(k) > 0 THEN 'Keywords: ' || array_to_string(k, ', ') END, CASE WHEN h <> '' THEN 'Topic: ' || h END) AS enriched FROM k""")
def enriched_summary(spark: SparkSession, d: str) -> DataFrame:
    return base.memories(spark, d).select("memory_id", T.enriched_summary("summary", "content").alias("enriched"))


AGE = f"(epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(created_at)) / 1e6"


@query(f"""WITH {MEM}, n AS (SELECT memory_id, created_at, coalesce(len(refs), 0) AS r, greatest(coalesce(try_cast(metadata['turns'] AS BIGINT), 0), 0) AS a FROM mem)
SELECT memory_id, round(CASE WHEN created_at IS NULL THEN 0.5 ELSE greatest(0, least(1, 0.4 * ln(1 + a) / ln(101) + 0.3 * exp(-greatest(0, floor({AGE} / 86400)) / 30) + 0.3 * ln(1 + r) / ln(11))) END, 6) AS importance FROM n""")
def importance_scores(spark: SparkSession, d: str) -> DataFrame:
    turns = F.try_element_at("metadata", F.lit("turns")).try_cast("bigint")
    return base.memories(spark, d).select("memory_id", F.round(scoring.importance(turns, F.col("created_at"), F.size("refs"), base.as_of()), 6).alias("importance"))


@query(f"""WITH {MEM} SELECT memory_id, round(CASE WHEN created_at IS NULL THEN 0.5 ELSE greatest(0, least(1, exp(-greatest(0, {AGE} / 3600) / greatest(24.0 * CASE coalesce(memory_type, 'working') WHEN 'working' THEN 1 WHEN 'short_term' THEN 3 WHEN 'long_term' THEN 6 ELSE 4 END, 1)))) END, 6) AS recency FROM mem""")
def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return base.memories(spark, d).select("memory_id", F.round(scoring.recency("created_at", "memory_type", base.as_of(), 24.0), 6).alias("recency"))


@query(f"WITH {MEM} SELECT memory_id, round(CASE WHEN coalesce(len(refs), 0) > 0 THEN least(1, ln(1 + len(refs)) / ln(11)) ELSE 0 END, 6) AS reliability, round(least(1, coalesce(strength, 0.5) + 0.1), 6) AS boosted FROM mem")
def refs_reliability(spark: SparkSession, d: str) -> DataFrame:
    return base.memories(spark, d).select("memory_id", F.round(scoring.refs_reliability(F.size("refs")), 6).alias("reliability"), F.round(scoring.boosted_strength("strength"), 6).alias("boosted"))
