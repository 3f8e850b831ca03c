import math
import random

import pytest
from pyspark.sql import functions as F

from recollary.operators import evaluate


def test_precision_and_ndcg(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "query_id long, item string, rank int")
    qrels = spark.createDataFrame([(1, "topic", "X "), (1, "severity", "high"), (2, "topic", "none")], "query_id long, key string, value string")
    attributes = spark.createDataFrame([("a", "topic", "x"), ("b", "topic", "y"), ("c", "severity", "HIGH"), ("b", "severity", None)], "item string, key string, value string")
    ideal = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "query_id long, ideal_hits int")
    got = {r.query_id: r for r in evaluate.precision_ndcg(evaluate.judged(results, qrels, attributes, "item"), ideal, 3).collect()}
    assert got[1].hits == 2 and got[1].precision == pytest.approx(2 / 3)
    assert got[1].ndcg == pytest.approx(1 + 1 / math.log2(4))  # more hits than ideal: above 1
    assert (got[2].precision, got[2].ndcg, got[3].precision, got[3].ndcg) == (0, 0, 0, 0)


def test_positions_match_sorting(spark):
    rng = random.Random(3)
    values = [round(rng.choice([rng.random(), 0.5, 100.0]), 3) for _ in range(333)]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 7.0), ("g", None)], "g string, v double")
    got = {r.g: r for r in evaluate.percentiles(df, "v", ["g"], {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    ordered = sorted(values)
    assert (got["g"].n, got["g"].p50, got["g"].p95, got["g"].p100) == (333, ordered[166], ordered[int(333 * 0.95)], ordered[-1])
    assert got["one"].p50 == 7.0
    d = {r.g: r for r in evaluate.distribution(df, "v", ["g"]).collect()}["g"]
    assert d.upper_median == ordered[333 // 2] and d.mean == pytest.approx(sum(values) / 333)


def test_confusion_and_regressions(spark):
    df = spark.createDataFrame([("k", True, True), ("k", True, False), ("k", False, True), ("k", None, None), ("l", None, None)], "g string, p boolean, a boolean")
    got = {r.g: r for r in evaluate.confusion(df, F.col("p"), F.col("a"), ["g"]).collect()}
    assert (got["k"].tp, got["k"].fp, got["k"].fn, got["k"].tn, got["k"].precision) == (1, 1, 1, 1, 0.5)
    assert got["l"].precision == 0
    a = spark.createDataFrame([("p", 0.9), ("q", 0.5)], "metric string, value double")
    b = spark.createDataFrame([("p", 0.8), ("q", 0.49), ("r", 1.0)], "metric string, value double")
    assert {r.metric: r.regressed for r in evaluate.regressions(a, b, 0.02).collect()} == {"p": True, "q": False}


def test_training_matches_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [([rng.random() for _ in evaluate.FEATURES], rng.randrange(2)) for _ in range(20)]
    w, b = [0.1] * 6, 0.0
    for _ in range(5):
        e = [1 / (1 + math.exp(-(b + sum(x * y for x, y in zip(w, f))))) - y for f, y in rows]
        g = [sum(ei * f[j] for ei, (f, _) in zip(e, rows)) / len(rows) + 0.01 * w[j] for j in range(6)]
        b -= 0.2 * sum(e) / len(rows)
        w = [x - 0.2 * y for x, y in zip(w, g)]
    w = [max(0, x) for x in w]
    want = [x / sum(w) for x in w]
    df = spark.createDataFrame([(*f, y) for f, y in rows], ", ".join(f"{f} double" for f in evaluate.FEATURES) + ", is_relevant int")
    assert list(evaluate.train_weights(df, epochs=5).values()) == pytest.approx(want, abs=1e-9)
    assert sum(evaluate.train_weights(df.limit(0)).values()) == pytest.approx(1)


def test_positions_with_an_outlier(spark):
    rows = [("g", float(i)) for i in range(1000)] + [("g", 1e12), ("h", 5.0), ("h", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.n, r.p50, r.p95) for r in evaluate.percentiles(df, "x", ["g"], {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"g": (1001, 500.0, 950.0), "h": (1, 5.0, 5.0)}
