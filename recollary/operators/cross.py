"""Second-stage reranking with its three caches. The scorer is pluggable; a formula is the default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollary.functions import scoring
from recollary.functions.text import keyword_signature, words
from recollary.functions.vector import cosine


def cross_rerank(results: DataFrame, scorer: Column, candidates: int = 3, least_words: int = 4) -> DataFrame:
    """Reorders each query's first candidates (memory entries before others, if there are any) by scorer.

    Queries of fewer than least_words words keep their order. The rest follows in its old order."""
    by_query = Window.partitionBy("query_id")
    entry = F.col("chunk_index").isNull()
    first = F.row_number().over(by_query.orderBy(entry.desc(), "position"))
    ranked = results.withColumn("turn", first).withColumn("asked", (F.size(words("query")) >= least_words) & (F.col("turn") <= candidates))
    scored = ranked.withColumn("cross_score", F.when(F.col("asked"), scorer))
    order = by_query.orderBy(F.when(F.col("asked"), 0).otherwise(1), F.round("cross_score", 9).desc_nulls_last(), F.when(F.size(words("query")) < least_words, F.col("position")).otherwise(F.col("turn")))
    return scored.withColumn("new_position", F.row_number().over(order)).drop("turn", "asked")


def parsed_score(answer: str | Column) -> Column:
    """A model's answer as score: its first number, 0 if there is none or it is beyond 1.5, at most 1."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    value = F.try_to_number(F.regexp_extract(answer, r"^\s*(\d\.\d{1,6})", 1), F.lit("9.999999")).cast("double")
    plain = F.regexp_extract(answer, r"^\s*([01])\b", 1)
    value = F.coalesce(value, F.when(plain != "", plain.cast("double")))
    return F.when(value.isNull() | (value < 0) | (value > 1.5), 0.0).otherwise(F.least(F.lit(1.0), value))


def cached(asked: DataFrame, cache: DataFrame, as_of: Column, ttl_seconds: int = 900) -> DataFrame:
    """Adds l1, l2, l3 (scores or null) and hit (the first that is not null) to asked pairs.

    asked: query_id, query, query_vector, project_id, entry_id. cache: query, query_vector, project_id,
    entry_id, score, cached_at. l1: the same query; l2: the same three keywords; l3: by the similarity of the
    first cached query, in order of caching, that is similar enough. Only rows within the time to live count."""
    live = cache.where((F.unix_micros(as_of) - F.unix_micros("cached_at")) / 1e6 <= ttl_seconds)
    key = lambda: F.concat_ws("::", F.lower(F.trim("query")), "project_id", "entry_id")
    mark = lambda: F.concat_ws("::", keyword_signature("query"), "project_id", "entry_id")
    exact = live.groupBy(key().alias("_k")).agg(F.max_by("score", "cached_at").alias("l1"))
    loose = live.groupBy(mark().alias("_m")).agg(F.max_by("score", "cached_at").alias("l2"))
    # of a candidate's cached queries only the last ten are kept
    last = Window.partitionBy("entry_id").orderBy(F.col("cached_at").desc())
    recent = live.withColumn("_n", F.row_number().over(last)).where("_n <= 10").select("entry_id", F.col("query_vector").alias("_v"), F.col("cached_at").alias("_at"))
    near = asked.join(recent, "entry_id").withColumn("_s", scoring.semantic_cache_score(cosine("query_vector", "_v"))).where("_s is not null")
    near = near.groupBy("query_id", "entry_id").agg(F.min_by("_s", "_at").alias("l3"))
    found = asked.withColumn("_k", key()).withColumn("_m", mark()).join(exact, "_k", "left").join(loose, "_m", "left").drop("_k", "_m")
    return found.join(near, ["query_id", "entry_id"], "left").withColumn("hit", F.coalesce("l1", "l2", "l3"))


def written_back(cache: DataFrame, fresh: DataFrame, capacity: int = 10_000) -> DataFrame:
    """The cache with fresh rows, the last ten of each candidate, and the most recently cached in all."""
    both = cache.unionByName(fresh)
    last = Window.partitionBy("entry_id").orderBy(F.col("cached_at").desc(), "query")
    kept = both.withColumn("_n", F.row_number().over(last)).where("_n <= 10").drop("_n")
    return kept.orderBy(F.col("cached_at").desc(), "query", "entry_id").limit(capacity)


def cache_metrics(looked_up: DataFrame) -> DataFrame:
    """pairs, and the share of each cache level among the hits; shares are 0 without pairs."""
    n = F.count("*")
    share = lambda c: F.coalesce(F.try_divide(F.sum(c.cast("int")), n), F.lit(0.0))
    one, two = F.col("l1").isNotNull(), F.col("l1").isNull() & F.col("l2").isNotNull()
    three = F.col("l1").isNull() & F.col("l2").isNull() & F.col("l3").isNotNull()
    return looked_up.agg(n.alias("pairs"), share(one).alias("l1_rate"), share(two).alias("l2_rate"), share(three).alias("l3_rate"), share(F.col("hit").isNotNull()).alias("hit_rate"))
