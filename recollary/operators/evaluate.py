"""Measuring retrieval: precision, NDCG, distributions, percentiles, regressions, weight training."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ["memory_strength", "recency", "refs_reliability", "bm25_score", "vector_similarity", "metadata_bonus"]


def judged(results: DataFrame, qrels: DataFrame, attributes: DataFrame, item: str) -> DataFrame:
    """results (query_id, item, rank) with relevant: whether any judged key has the item's value.

    qrels: query_id, key, value. attributes: item, key, value. Compared without case."""
    value = lambda c: F.lower(F.trim(c))
    right = results.join(attributes.select(item, "key", value("value").alias("v")), item).join(qrels.select("query_id", "key", value("value").alias("v")), ["query_id", "key", "v"], "left_semi").select("query_id", item).distinct()
    return results.join(right.withColumn("relevant", F.lit(1)), ["query_id", item], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))


def precision_ndcg(of: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """query_id, hits, precision, ndcg at k. ideal: query_id, ideal_hits; ndcg may exceed 1 where there are more."""
    top = of.where(F.col("rank") <= k)
    sums = top.groupBy("query_id").agg(F.count("*").alias("returned"), F.sum("relevant").alias("hits"), F.sum(F.col("relevant") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = F.lit(0.0)
    for i in range(1, k + 1):
        best = best + F.when(F.col("ideal_hits") >= i, 1 / math.log2(i + 1)).otherwise(0.0)
    joined = ideal.join(sums, "query_id", "left").na.fill(0, ["returned", "hits"]).na.fill(0.0, ["dcg"])
    size = F.least(F.lit(k), F.col("returned"))
    return joined.select("query_id", "hits", F.coalesce(F.try_divide("hits", size), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("dcg", best), F.lit(0.0)).alias("ndcg"))


def ideal_hits(explicit: Column, relevance: Column) -> Column:
    """The given number, else that of all judged values, at least 1."""
    listed = F.aggregate(F.map_values(relevance), F.lit(0), lambda s, v: s + F.greatest(F.lit(0), F.size(v)))
    return F.coalesce(explicit, F.greatest(F.lit(1), F.coalesce(listed, F.lit(0))))


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, mean, upper_median, least, most, deviation (population) of the values that are not null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    total = counts.groupBy(*by).agg(
        F.sum("m").alias("n"),
        (F.sum(F.col(value) * F.col("m")) / F.sum("m")).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(value) * F.col(value) * F.col("m")) / F.sum("m") - F.pow(F.sum(F.col(value) * F.col("m")) / F.sum("m"), 2))).alias("deviation"),
    )
    middle = positions(counts, value, by, {"upper_median": None})
    return total.join(middle, by)


def positions(counts: DataFrame, value: str, by: list[str], shares: dict[str, float | None], ranges: int = 128) -> DataFrame:
    """by and one column a share: the value at index int(n x share) of the sorted values of each group (None:
    n // 2, the upper median).

    counts: by, value, m (rows of that value). The different values are cut into ranges of about equal number
    first, at approximate quantiles: only the range that holds the index is ordered, so no group is sorted in
    one task as a whole, however uneven its values are."""
    v = F.col(value)
    cuts = F.percentile_approx(v, [i / ranges for i in range(1, ranges)], 20 * ranges)
    ends = counts.groupBy(*by).agg(F.array_distinct(cuts).alias("_cuts"), F.sum("m").alias("_n"))
    binned = counts.join(ends, by).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c <= v))).drop("_cuts")
    per_bin = binned.groupBy(*by, "_bin").agg(F.sum("m").alias("_in"), F.first("_n").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    upto = per_bin.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    out = None
    for name, share in shares.items():
        index = F.floor(F.col("_n") / 2) if share is None else F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1)
        target = upto.withColumn("_i", index).where((F.col("_i") >= F.col("_before")) & (F.col("_i") < F.col("_before") + F.col("_in"))).select(*by, "_bin", "_before", "_i")
        running = F.sum("m").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        inside = binned.join(target, [*by, "_bin"]).withColumn("_c", F.col("_before") + running)
        found = inside.where(F.col("_c") > F.col("_i")).groupBy(*by).agg(F.min(v).alias(name))
        out = found if out is None else out.join(found, by)
    return out


def percentiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by, n and the value at index int(n x share) of the sorted values, for each share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    n = counts.groupBy(*by).agg(F.sum("m").alias("n"))
    return n.join(positions(counts, value, by, shares), by)


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, tn, precision, recall, f1, fp_rate, fn_rate; a rate without cases is 0."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    rate = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "fp_rate": rate(fp, fp + tn), "fn_rate": rate(fn, fn + tp)})


def histogram(df: DataFrame, value: str, width: float, by: list[str]) -> DataFrame:
    """by, low, n: the rows in each band of the given width."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.round(F.floor(F.round(F.col(value) / width, 9)) * width, 6).alias("low")).agg(F.count("*").alias("n"))


def regressions(baseline: DataFrame, current: DataFrame, tolerance: float) -> DataFrame:
    """metric, baseline, current, drop, regressed. Inputs: metric, value. Metrics of one side only are left out."""
    joined = baseline.select("metric", F.col("value").alias("baseline")).join(current.select("metric", F.col("value").alias("current")), "metric")
    drop = F.col("baseline") - F.col("current")
    return joined.select("metric", "baseline", "current", drop.alias("drop"), (drop > tolerance).alias("regressed"))


def degradation(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """by, first, last, change: mean value of the last tenth of the order against the first tenth."""
    edges = positions(df.where(F.col(order).isNotNull()).groupBy(*by, order).agg(F.count("*").alias("m")), order, by, {"_from": 0.1, "_to": 0.9})
    joined = df.join(edges, by)
    means = joined.groupBy(*by).agg(F.avg(F.when(F.col(order) < F.col("_from"), F.col(value))).alias("first"), F.avg(F.when(F.col(order) >= F.col("_to"), F.col(value))).alias("last"))
    return means.withColumn("change", F.try_divide(F.col("last") - F.col("first"), "first"))


def routing_metrics(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, calls, total, longest, latest, mean latency of calls (at, latency)."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("latency").alias("total"), F.max("latency").alias("longest"), F.max_by("latency", "at").alias("latest"), F.avg("latency").alias("mean"))


def queue_stats(jobs: DataFrame, most: int = 3) -> DataFrame:
    """pending, failed (tried most times), retries of a job table."""
    return jobs.agg(F.count_if(F.col("retry_count") < most).alias("pending"), F.count_if(F.col("retry_count") >= most).alias("failed"), F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"))


def gate(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """metric, value, floor, passed for each floor; a missing metric fails."""
    joined = floors.join(metrics, "metric", "left")
    return joined.select("metric", "value", "floor", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)).alias("passed"))


def train_weights(rows: DataFrame, label: str = "is_relevant", epochs: int = 400, rate: float = 0.2, decay: float = 0.01) -> dict[str, float]:
    """Rerank weights by logistic regression, full-batch gradient descent; then clipped at 0 and scaled to sum 1.

    Each epoch is one aggregation over the (cached) rows; only the seven gradients come to the driver. If all
    weights end at 0 they are equal."""
    data = rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES], F.col(label).cast("double").alias("y")).persist()
    try:
        n = data.count()
        weights, bias = [0.1] * len(FEATURES), 0.0
        for _ in range(epochs if n else 0):
            z = F.lit(bias)
            for w, f in zip(weights, FEATURES):
                z = z + F.lit(w) * F.col(f)
            error = 1 / (1 + F.exp(-z)) - F.col("y")
            g = data.agg(*[F.avg(error * F.col(f)).alias(f) for f in FEATURES], F.avg(error).alias("bias")).first()
            weights = [w - rate * (g[f] + decay * w) for w, f in zip(weights, FEATURES)]
            bias -= rate * g["bias"]
    finally:
        data.unpersist()
    clipped = [max(0.0, w) for w in weights]
    total = sum(clipped)
    return {f: (w / total if total else 1 / len(FEATURES)) for f, w in zip(FEATURES, clipped)}
