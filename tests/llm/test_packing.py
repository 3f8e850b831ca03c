import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollary.llm import packing


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=300), st.integers(4, 60))
def test_byte_cuts(text, capacity):
    made = packing.byte_cuts(text, capacity)
    assert "".join(text[a:b] for a, b, _ in made) == text
    assert all(len(text[a:b].encode("utf-8", "surrogatepass")) == n <= capacity for a, b, n in made)


def test_best_fit_constraints():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 1000, 500)
    for rule in ("norm", "dot"):
        bins = packing.best_fit(sizes, 1000, 7, 600_000.0, rule=rule)
        for b in set(bins):
            own = sizes[bins == b]
            assert own.sum() <= 1000 and len(own) <= 7 and ((own.astype(float) ** 2).sum() <= 600_000 or len(own) == 1)
    free = packing.best_fit(sizes, 1000, 10_000, 1e12)
    assert sizes.sum() / (1000 * len(set(free))) > 0.97


def test_operator(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 900)) for i in range(300)] + [(1000, "x" * 10_000), (1001, None), (1002, ""), (1003, "y" * 4096), (1004, "y" * 4097)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("x"), "shard": F.lit(1), "n": F.lit(2), "key": F.lit(3)})
    got = packing.pack(df, shard=100).collect()
    texts = dict(rows)
    held, pieces = {}, {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.n_pieces, r.tokens))
    assert max(held.values()) <= 4096 and set(pieces) == set(texts)
    for key, parts in pieces.items():
        text = texts[key] or ""
        assert "".join(text[s : s + n] for _, s, n, _, _ in sorted(parts)) == text and {p[3] for p in parts} == {len(parts)}
        assert sum(p[4] for p in parts) == len(text.encode())
    assert {k for k, p in pieces.items() if len(p) > 1} == {1000, 1004}
    report = packing.packing_report(packing.pack(df)).first()
    assert report.fill > 0.95 and report["items"] == len(got)
    assert packing.pack(df.limit(0)).count() == 0


def test_other_tokenizer(spark):
    cuts = packing.tokenizer_cuts(lambda t: t.split())
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b")], "doc_id long, text string")
    got = packing.pack(df, capacity=3, cuts=cuts).collect()
    assert sum(r.tokens for r in got) == 9 and max(r.tokens for r in got) <= 3


def test_limits_bind(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "x" * (3000 if i % 9 == 0 else rng.randint(1, 400))) for i in range(500)], "doc_id long, text string")
    limits = {"max_docs": 12, "max_cost": 4096**2 / 3}
    got = packing.pack(df, **limits)
    report = packing.packing_report(got, **limits).first()
    assert report.broken == 0 and report.full_of_items > 0 and report.full_of_cost > 0 and report["items"] == 500
    alone = {r.container for r in got.where("tokens = 3000").collect()}  # 3000 squared is beyond the limit
    assert got.where(F.col("container").isin(list(alone))).count() == len(alone) == 56


def test_pieces_count_for_shards(spark):
    df = spark.createDataFrame([(i, "ab" * 20_000) for i in range(6)], "doc_id long, text string")
    got = packing.pack(df, shard=10)
    assert got.select(F.split("container", "-")[0].alias("s")).distinct().count() > 3
    assert packing.packing_report(got).first().broken == 0


def test_report_of_nothing(spark):
    row = packing.packing_report(packing.pack(spark.createDataFrame([], "doc_id long, text string"))).first()
    assert row.containers == 0 and row.fill is None and row.broken == 0
