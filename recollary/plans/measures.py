"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollary.functions.text import words
from recollary.operators import bm25, evaluate
from recollary.plans import base
from recollary.plans.registry import EVENT, MEM, SEARCH, query, tokens
from recollary.plans.retrieval import BM25
from recollary.session import load

K = 10
JUDGED = f"""{BM25}, {MEM}, hits AS (SELECT query_id, chunk_id, rank, memory_id FROM bm_top JOIN chk USING (chunk_id) WHERE rank <= {K}),
attr AS (SELECT memory_id, 'topic' AS key, lower(trim(topic)) AS v FROM mem UNION ALL SELECT memory_id, 'severity', lower(trim(severity)) FROM mem UNION ALL SELECT memory_id, 'language', lower(trim(language)) FROM mem),
qrel AS (SELECT query_id, e.key AS key, lower(trim(unnest(e.value))) AS v FROM (SELECT query_id, unnest(map_entries(relevance)) AS e FROM asked)),
good AS (SELECT DISTINCT h.query_id, h.chunk_id FROM hits h JOIN attr a ON h.memory_id = a.memory_id JOIN qrel q ON q.query_id = h.query_id AND q.key = a.key AND q.v = a.v),
marked AS (SELECT h.*, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END AS relevant FROM hits h LEFT JOIN good g USING (query_id, chunk_id)),
ideal AS (SELECT query_id, coalesce(ideal_hits, greatest(1, coalesce(list_sum(list_transform(map_values(relevance), lambda v: coalesce(len(v), 0))), 0)))::INT AS ideal FROM asked WHERE relevance IS NOT NULL),
scores AS (SELECT i.query_id, coalesce(sum(relevant), 0)::BIGINT AS hits, coalesce(sum(relevant) / least({K}, count(chunk_id)), 0) AS precision,
  coalesce(sum(relevant / log2(rank + 1)), 0) / nullif(any_value((SELECT sum(1 / log2(x + 1)) FROM range(1, least({K}, ideal) + 1) r(x))), 0) AS ndcg
  FROM ideal i LEFT JOIN marked m USING (query_id) GROUP BY i.query_id, ideal)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    stated = base.stated(spark, d)
    chunks = base.chunks(spark, d)
    results = bm25.search(chunks, stated, K).join(chunks.select("chunk_id", "memory_id"), "chunk_id")
    m = base.memories(spark, d)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("topic", "severity", "language")]))
    attributes = m.select("memory_id", pairs.alias("p")).select("memory_id", "p.*")
    qrels = stated.select("query_id", F.explode("relevance").alias("key", "values")).select("query_id", "key", F.explode("values").alias("value"))
    by_chunk = attributes.join(results.select("chunk_id", "memory_id").distinct(), "memory_id").drop("memory_id")
    marked = evaluate.judged(results, qrels, by_chunk, "chunk_id")
    ideal = stated.where("relevance is not null").select("query_id", evaluate.ideal_hits(F.col("ideal_hits"), F.col("relevance")).alias("ideal_hits"))
    return evaluate.precision_ndcg(marked, ideal, K)


@query(f"WITH {JUDGED} SELECT query_id, hits, round(precision, 6) AS precision, round(coalesce(ndcg, 0), 6) AS ndcg FROM scores")
def precision_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("query_id", "hits", F.round("precision", 6).alias("precision"), F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {JUDGED} SELECT query_id FROM scores WHERE hits = 0")
def zero_hit_queries(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).where("hits = 0").select("query_id")


@query(f"WITH {JUDGED} SELECT count(*) AS judged, round(avg(precision), 6) AS macro_precision, round(avg(coalesce(ndcg, 0)), 6) AS macro_ndcg FROM scores")
def macro_scores(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).agg(F.count("*").alias("judged"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("ndcg"), 6).alias("macro_ndcg"))


@query(f"""WITH {MEM} SELECT schema_type, count(strength) AS n, round(avg(strength), 6) AS mean, list_sort(list(strength))[count(strength) // 2 + 1] AS upper_median, min(strength) AS least, max(strength) AS most, round(stddev_pop(strength), 6) AS deviation
FROM mem WHERE strength IS NOT NULL GROUP BY 1""")
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.distribution(base.memories(spark, d).where("schema_type is not null"), "strength", ["schema_type"])
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query(f"WITH {MEM} SELECT schema_type, round(floor(round(strength / 0.2, 9)) * 0.2, 6)::DOUBLE AS low, count(*) AS n FROM mem WHERE strength IS NOT NULL GROUP BY 1, 2")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(base.memories(spark, d), "strength", 0.2, ["schema_type"])


@query(f"""WITH {EVENT}, x AS (SELECT coalesce(role, 'unknown') AS role, (epoch_us(received_at) - epoch_us(ts)) / 1e6 AS delay FROM ev), y AS (SELECT role, list_sort(list(delay)) AS l FROM x WHERE delay IS NOT NULL GROUP BY 1)
SELECT role, len(l) AS n, l[least(floor(len(l) * 0.5), len(l) - 1)::INT + 1] AS p50, l[least(floor(len(l) * 0.95), len(l) - 1)::INT + 1] AS p95, l[least(floor(len(l) * 0.99), len(l) - 1)::INT + 1] AS p99 FROM y""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    delay = (F.unix_micros("received_at") - F.unix_micros("ts")) / 1e6
    rows = base.events(spark, d).select(F.coalesce("role", F.lit("unknown")).alias("role"), delay.alias("delay"))
    return evaluate.percentiles(rows, "delay", ["role"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"""WITH {MEM}, c AS (SELECT schema_type, coalesce(strength >= 0.5, FALSE) AS p, coalesce(importance BETWEEN 0.5 AND 1, FALSE) AS a FROM mem),
n AS (SELECT schema_type, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM c GROUP BY 1)
SELECT schema_type, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fp_rate, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fn_rate FROM n""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.confusion(base.memories(spark, d), F.col("strength") >= 0.5, F.col("importance").between(0.5, 1), ["schema_type"])
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "fp_rate", "fn_rate")})


HALVES = "SELECT category AS metric, avg(CASE WHEN relevance IS NOT NULL THEN 1.0 ELSE 0.0 END) AS value FROM search s WHERE category IS NOT NULL AND query_id % 2 = {0} GROUP BY 1"


@query(f"WITH {SEARCH}, b AS ({HALVES.format(0)}), c AS ({HALVES.format(1)}) SELECT metric, round(b.value, 6) AS baseline, round(c.value, 6) AS current, round(b.value - c.value, 6) AS drop, b.value - c.value > 0.02 AS regressed FROM b JOIN c USING (metric)")
def regression_delta(spark: SparkSession, d: str) -> DataFrame:
    """Share of judged searches by category, runs of even numbers against those of odd ones."""
    rows = base.searches(spark, d).where("category is not null")
    side = lambda k: rows.where(f"query_id % 2 = {k}").groupBy(F.col("category").alias("metric")).agg(F.avg(F.when(F.col("relevance").isNotNull(), 1.0).otherwise(0.0)).alias("value"))
    return evaluate.regressions(side(0), side(1), 0.02).withColumns({c: F.round(c, 6) for c in ("baseline", "current", "drop")})


@query(f"""WITH {SEARCH}, w AS (SELECT DISTINCT query_id, unnest({tokens("query")}) AS word FROM search WHERE relevance IS NULL)
SELECT word, count(*) AS n FROM w WHERE length(word) > 3 AND word NOT IN ('what', 'with', 'from', 'that') GROUP BY 1""")
def gap_words(spark: SparkSession, d: str) -> DataFrame:
    """How many unjudged searches hold each longer word."""
    found = base.searches(spark, d).where("relevance is null").select(F.explode(F.array_distinct(words("query"))).alias("word"))
    return found.where((F.length("word") > 3) & ~F.col("word").isin("what", "with", "from", "that")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""WITH {SEARCH}, c AS (SELECT CASE WHEN relevance IS NULL THEN 'none' WHEN cardinality(relevance) >= 2 THEN 'covered' ELSE 'partial' END AS coverage FROM search) SELECT coverage, count(*) AS n FROM c GROUP BY 1""")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    coverage = F.when(F.col("relevance").isNull(), "none").when(F.size("relevance") >= 2, "covered").otherwise("partial")
    return base.searches(spark, d).groupBy(coverage.alias("coverage")).agg(F.count("*").alias("n"))


@query(f"WITH {SEARCH} SELECT coalesce(category, 'all') AS category, count(*) AS n, count(relevance) AS judged FROM search WHERE category IS NOT NULL GROUP BY ROLLUP (category)")
def searches_by_category(spark: SparkSession, d: str) -> DataFrame:
    rows = base.searches(spark, d).where("category is not null").rollup("category").agg(F.count("*").alias("n"), F.count("relevance").alias("judged"))
    return rows.withColumn("category", F.coalesce("category", F.lit("all")))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)""")
def shipment_cube(spark: SparkSession, d: str) -> DataFrame:
    """Relational extension: grouping sets over a large table with a pushed-down filter."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    money = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(money), 2).alias("revenue"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT n_name, c_custkey, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, c_custkey, round(total, 2) AS total, row_number() OVER (PARTITION BY n_name ORDER BY round(total, 4) DESC, c_custkey) AS rank FROM t QUALIFY rank <= 3""")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """Relational extension: joins, aggregation and a per-group top k."""
    orders = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    joined = load(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    best = Window.partitionBy("n_name").orderBy(F.round("total", 4).desc(), "c_custkey")
    return joined.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("n_name", "c_custkey", F.round("total", 2).alias("total"), "rank")
