"""BM25 search (Okapi) over white-space tokens, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollary.functions.text import words
from recollary.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, term, dl, tf: one row per term of a document; only of the terms, if they are given, which leaves
    out the others before anything is grouped. Texts without tokens have none. Write it as a table partitioned
    by term to search without reading the texts again."""
    tokens = docs.select(F.col(key).alias("doc_id"), words(text).alias("w")).select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    wanted = tokens if terms is None else tokens.join(terms.select("term").distinct(), "term", "left_semi")
    return wanted.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """term, df, total over all documents, counted map-side first, in one pass over the texts. The row without
    a term has the number of documents and their total length; texts without tokens have length 0."""
    tokens = docs.select(words(text).alias("w"))
    each = tokens.select(F.size("w").cast("long").alias("dl"), F.explode(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))


def statistics(frequencies: DataFrame) -> DataFrame:
    """One row: n_docs and the mean length."""
    return frequencies.where("term is null").select(F.col("df").alias("n_docs"), (F.col("total") / F.col("df")).alias("avgdl"))


def term_weights(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """term, idf. Negative ones are replaced by EPSILON times the mean over the vocabulary."""
    counted = frequencies.crossJoin(F.broadcast(stats.select("n_docs")))
    raw = counted.select("term", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def search(docs: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "content", query_id: str = "query_id", query: str = "query", index: DataFrame | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """query_id, the key, score, rank: the k best documents of each query with a score other than 0.

    A token repeated in the query counts again. Ties go to the smaller key. The statistics come from all
    documents. index (postings) and frequencies (document_frequencies) are used where they are given, and
    made from the documents where they are not."""
    known = cut(document_frequencies(docs, text)) if frequencies is None else frequencies
    stats = statistics(known)
    weights = term_weights(known.where("term is not null"), stats)
    asked = queries.select(query_id, F.explode(words(query)).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))
    weighted = cut(asked.join(weights, "term"))
    held = postings(docs, key, text, weighted) if index is None else index.join(weighted.select("term").distinct(), "term", "left_semi")
    hits = held.join(weighted, "term").crossJoin(F.broadcast(stats.select("avgdl")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(query_id, "doc_id").agg(F.sum(part * F.col("times")).alias("score")).where("score <> 0")
    # the order of adding must not decide between equal scores
    best = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_id, F.col("doc_id").alias(key), "score", "rank")
