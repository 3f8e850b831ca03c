"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollary.llm import encoding, fusion, graph, language, leakage, packing, privacy, split
from recollary.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member order alone decides these rows; the votes of the sources decide those of p1_fused."""
    return fusion.preferred(load(spark, sf_dir, "memories"))


def p1_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors by the votes of the sources alone."""
    return fusion.survivors(load(spark, sf_dir, "memories")).withColumn("probability", F.round("probability", 6))


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fusion.source_report(load(spark, sf_dir, "memories"))
    return known.select("source", F.round("accuracy", 6).alias("accuracy"), "origin", F.round("dependent", 6).alias("dependent"))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every chunk, however far: larger shards, more edges and wider beams than for near ones."""
    return graph.most_similar(load(spark, sf_dir, "chunks"), shards=4, degree=32, beam=64, cell=2048)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graph.most_similar(load(spark, sf_dir, "chunks"), min_similarity=0.9)
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory contents and stored chunk contents as item_kind, item_id, content."""
    memories = load(spark, sf_dir, "memories").select(F.lit("memory").alias("item_kind"), F.col("memory_id").alias("item_id"), "content")
    chunks = load(spark, sf_dir, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "content")
    return memories.unionByName(chunks)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(items(spark, sf_dir), ["item_kind", "item_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_index = 0").select("item_kind", "item_id").distinct()


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_kind, item_id, labels (as they are, canonical where they name a language), languages, segments."""
    memories = load(spark, sf_dir, "memories")
    runs = load(spark, sf_dir, "query_runs").where("request.method in ('search_memory', 'search_in_project') and relevance is not null")
    named = lambda x: F.coalesce(language.canonical(x), F.lower(F.trim(x)))
    texts = memories.select(
        F.lit("memory").alias("item_kind"),
        F.col("memory_id").alias("item_id"),
        "content",
        F.array_compact(F.array(named(F.col("language")))).alias("labels"),
    ).unionByName(
        runs.select(
            F.lit("query_run").alias("item_kind"),
            F.col("run_id").cast("string").alias("item_id"),
            F.col("request.params.query").alias("content"),
            F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform(F.try_element_at("relevance", F.lit("language")), named)))), F.array().cast("array<string>")).alias("labels"),
        )
    )
    return language.detect(texts, language.trained(memories), ["item_kind", "item_id"], others=["labels"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = p4_languages(spark, sf_dir).where(F.col("labels") != F.col("languages"))
    return wrong.select("item_kind", "item_id", F.explode("languages").alias("language")).distinct()


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = p4_languages(spark, sf_dir).select("item_kind", "item_id", F.posexplode("segments").alias("segment", "s"))
    return read.select("item_kind", "item_id", "segment", "s.*").distinct()


def private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory contents and the outputs of add_command runs as item_kind, item_id, content."""
    memories = load(spark, sf_dir, "memories").select(F.lit("memory").alias("item_kind"), F.col("memory_id").alias("item_id"), "content")
    runs = load(spark, sf_dir, "query_runs").where("request.method = 'add_command'")
    outputs = runs.select(F.lit("query_run").alias("item_kind"), F.col("run_id").cast("string").alias("item_id"), F.col("request.params.output").alias("content"))
    return memories.unionByName(outputs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = privacy.personal_information(private_texts(spark, sf_dir), ["item_kind", "item_id"])
    return spans.select("item_kind", "item_id", F.col("type").alias("pii_type")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.redact(private_texts(spark, sf_dir), ["item_kind", "item_id"])


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_packed(spark, sf_dir).where("n_pieces > 1 and piece = 0").select("doc_id").distinct()


# limits that bind on the documents: texts a container, and a third of the attention cost of one text that fills it
LIMITS = {"max_docs": 12, "max_cost": packing.CAPACITY**2 / 3}


def p6_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers under all three limits at once."""
    return packing.pack(load(spark, sf_dir, "documents"), **LIMITS)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of both packings: how full, by which limit, and whether any is broken."""
    plain = packing.packing_report(p6_packed(spark, sf_dir)).withColumn("packing", F.lit("tokens"))
    return plain.unionByName(packing.packing_report(p6_limited(spark, sf_dir), **LIMITS).withColumn("packing", F.lit("limited")))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep: each text's pieces in order make the whole text. doc_id, length, tokens, whole."""
    ends = F.transform("parts", lambda p: p["start"] + p["length"])
    starts = F.transform("parts", lambda p: p["start"])
    meet = F.slice(starts, 2, 1 << 30) == F.slice(ends, 1, F.greatest(F.lit(0), F.size("parts") - 1))
    # as many parts as the text has pieces, a few bytes each
    parts = p6_packed(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("parts"), F.sum("length").alias("length"), F.sum("tokens").alias("tokens"))
    return parts.select("doc_id", "length", "tokens", (meet & (starts[0] == 0)).alias("whole"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.copies(p7_leaks(spark, sf_dir)).where("verbatim").select("doc_id", "item_id").distinct()


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by their alignment score, with or without a run of 13 words."""
    return leakage.copies(p7_leaks(spark, sf_dir)).where("edited").select("doc_id", "item_id", "score", "longest_run")


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repair_encoding(load(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_repaired(spark, sf_dir).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_fused, p1_sources, p2_found, p2_neighbours, p3_found, p3_pieces, p4_found, p4_segments, p5_found, p5_redacted, p6_found, p6_packed, p6_limited, p6_fill, p6_kept, p7_found, p7_leaks, p7_edited, p8_found, p8_repaired]
    return {f.__name__: f for f in found}
