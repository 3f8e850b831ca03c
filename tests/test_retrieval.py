import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollary.operators import bm25, consolidate, cross, hybrid, tables, vectors


def plain_bm25(docs, query):
    tokens = {k: t.lower().split() for k, t in docs.items()}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {}
    for words in tokens.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    out = {}
    for k, words in tokens.items():
        s = sum(idf.get(w, 0) * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / avg)) for w in query.lower().split())
        if s:
            out[k] = s
    return out


def test_bm25_against_plain_python(spark):
    docs = {"a": "cat dog cat", "b": "dog bird", "c": "fish Dog fish fish", "d": "", "e": "owl"}
    df = spark.createDataFrame(list(docs.items()) + [("n", None)], "chunk_id string, content string").where("chunk_id <> 'n'")
    queries = spark.createDataFrame([(1, "cat cat dog"), (2, "owl"), (3, ""), (4, "nothing here")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in bm25.search(df, queries, 10).collect()}
    want = {(q, k): s for q, t in ((1, "cat cat dog"), (2, "owl")) for k, s in plain_bm25(docs, t).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_nearest_ties_and_unusable(spark):
    base = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vector array<float>")
    got = [(r.query_id, r.id, r.rank) for r in vectors.nearest(base, queries, 2, "id").orderBy("rank").collect()]
    assert got == [(1, "a", 1), (1, "b", 2)]


def test_nearest_in_blocks(spark):
    x = grouped_vectors(200, 8, 9)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    queries = base.where("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    rows = lambda **o: sorted((r.query_id, r.rank, r.id) for r in vectors.nearest(base, queries, 3, "id", **o).collect())
    assert rows() == rows(block=7) and len(rows()) == 150


def test_nearest_of_sizes_ties_and_many_rows(spark):
    x = np.random.default_rng(6).normal(size=(9000, 16)).astype(np.float32)
    x[3000:6000] = x[:3000]  # every one of these twice
    x[7000:9000] = x[10]  # many equal ones
    rows = [(f"{i:05d}", v.tolist()) for i, v in enumerate(x)] + [("short", [1.0, 2.0])]
    base = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    asked = [(1, x[0]), (2, x[10]), (3, x[20] + x[30]), (4, [1.0, 2.0]), (5, [1.0])]
    queries = spark.createDataFrame([(q, [float(e) for e in v]) for q, v in asked], "query_id long, query_vector array<float>")
    rows = lambda **o: [(r.query_id, r.rank, r.id, round(r.similarity, 9)) for r in vectors.nearest(base, queries, 40, "id", **o).orderBy("query_id", "rank").collect()]
    got = rows()
    assert got == rows(where=F.lit(True)) and len(got) == 200
    plan = vectors.nearest(base, queries, 40, "id")._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan  # no pair of a row and a query is a row


def grouped_vectors(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, size))
    x = np.repeat(centres, 4, axis=0) + rng.normal(scale=0.12, size=(n // 4 * 4, size))
    x[5] = x[4]  # equal vectors
    return x.astype(np.float32)


@pytest.mark.parametrize(("cell", "block", "scale"), [(128, 64, 1.0), (40, 500, 0.3), (5000, 50, 1.0)])
def test_similar_pairs_are_exact(spark, cell, block, scale):
    x = grouped_vectors(1200, 32, 1) * np.float32(scale) + np.float32(1 - scale)  # the smaller the scale, the closer all lie
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit.astype(np.float64) @ unit.T.astype(np.float64)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1))) if 5 not in (i, j)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 32, 0.9, cell=cell, block=block).collect()}
    assert got == want


def shuffled(spark):
    """Bytes that the session has shuffled."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def test_similar_pairs_of_vectors_far_apart(spark):
    x = np.random.default_rng(3).normal(size=(6000, 64)).astype(np.float32)
    x[1::2] = x[::2] + np.random.default_rng(4).normal(scale=0.2, size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"id": range(6000), "v": list(x)}), "id long, v array<float>").repartition(4).cache()
    df.count()
    before = shuffled(spark)
    found = vectors.similar_pairs(df, "id", "v", 64, 0.9, cell=100)
    got = {(r.a, r.b) for r in found.collect()}
    moved = shuffled(spark) - before
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert got == set(zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)))) and len(got) > 2900
    assert moved < 6 * x.nbytes  # however many vectors each has to meet


def test_similar_pairs_sent_in_turn(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 100)
    x = grouped_vectors(1200, 32, 2)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))) if 5 not in (i, j)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = [(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 32, 0.9, cell=128, block=64, sent=300).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def plain_leaders(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    leader = {}
    for i in range(n):
        if i not in leader:
            leader[i] = i
            for j in sorted(near[i]):
                if j > i and j not in leader:
                    leader[j] = i
    return leader


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_equal_greedy(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)})
    got = {r.id: r.leader for r in consolidate.leaders(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_leaders(40, edges)
    assert got == {i: want[i] for e in edges for i in e}


def test_leader_chain_is_not_a_component(spark):
    got = {r.id: r.leader for r in consolidate.leaders(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_leader_clusters_fixture(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.95, 0.05, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "insert_seq long, embedding array<float>")
    got = {r.id: r.leader for r in consolidate.leader_clusters(df, size=3).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_leader_clusters_of_vectors_far_apart(spark):
    x = np.random.default_rng(8).normal(size=(6000, 64)).astype(np.float32)
    x[1::2] = x[::2]  # copies
    df = spark.createDataFrame(pd.DataFrame({"insert_seq": range(6000), "embedding": list(x)}), "insert_seq long, embedding array<float>").repartition(4).cache()
    df.count()
    before = shuffled(spark)
    got = {r.id: r.leader for r in consolidate.leader_clusters(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(6000)}
    assert shuffled(spark) - before < 4 * x.nbytes


def candidates(spark, rows):
    at = datetime(2025, 1, 1)
    full = [(1, e, m, k, c, s, m or "p", "t", "chat", at + timedelta(hours=i), 10) for i, (e, m, k, c, s) in enumerate(rows)]
    return spark.createDataFrame(full, "query_id long, entry_id string, memory_id string, memory_type string, chunk_index int, score double, project_id string, topic string, source string, created_at timestamp, top_k int")


def test_dedup_slots(spark):
    rows = [
        ("m1-chunk-0", "m1", None, 0, 0.9), ("m1-metadata", "m1", "working", None, 0.5),  # the entry takes the chunk's slot
        ("m2-chunk-0", "m2", None, 0, 0.8), ("m2-metadata", "m2", "short_term", None, 0.4),  # a tie in priority: the chunk stays
        ("m3-metadata", "m3", "long_term", None, 0.7), ("m3-chunk-0", "m3", None, 0, 0.3),  # the chunk wins the slot
    ]
    df = candidates(spark, rows)
    got = [(r.position, r.entry_id) for r in hybrid.deduplicate(df, F.lit(10)).orderBy("position").collect()]
    assert got == [(1, "m1-metadata")]  # entries only, once any is among them
    general = [(r.position, r.entry_id) for r in hybrid.deduplicate_general(df).orderBy("position").collect()]
    assert general == got


def test_dedup_forms_agree(spark):
    rng = random.Random(5)
    rows = [(f"e{i}", f"m{rng.randrange(12)}", rng.choice(["working", "short_term", "long_term", None]), rng.choice([None, 0, 1]), rng.randrange(40) / 40) for i in range(60)]
    df = candidates(spark, rows)
    key = lambda f: sorted((r.position, r.entry_id) for r in f.collect())
    assert key(hybrid.deduplicate(df, F.lit(10))) == key(hybrid.deduplicate_general(df))


def test_merge_is_a_full_outer_join(spark):
    v = spark.createDataFrame([(1, "chunk-1", 0.95), (1, "chunk-2", 0.85)], "query_id long, entry_id string, similarity double")
    b = spark.createDataFrame([(1, "chunk-1", 15.3), (1, "chunk-3", 12.1)], "query_id long, entry_id string, score double")
    got = {r.entry_id: (r.similarity, r.bm25) for r in hybrid.merge(v, b).collect()}
    assert got == {"chunk-1": (0.95, 15.3), "chunk-2": (0.85, 0.0), "chunk-3": (0.0, 12.1)}


def test_project_search_falls_back(spark):
    pooled = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.1)], "query_id long, entry_id string, score double")
    full = spark.createDataFrame([(1, "x", 0.9), (2, "y", 0.9), (3, "z", 0.9)], "query_id long, entry_id string, score double")
    queries = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "query_id long, top_k int")
    got = {(r.query_id, r.entry_id) for r in hybrid.project_search(pooled, full, queries).collect()}
    assert got == {(1, "a"), (2, "y"), (3, "z")}


def test_cross_rerank(spark):
    rows = [(1, "one two three four", f"e{i}", None if i == 2 else 0, i, i / 10) for i in range(1, 6)] + [(2, "short query", "a", None, 1, 0.1), (2, "short query", "b", None, 2, 0.9)]
    df = spark.createDataFrame(rows, "query_id long, query string, entry_id string, chunk_index int, position int, s double")
    got = {q: [r.entry_id for r in cross.cross_rerank(df, F.col("s")).where(f"query_id = {q}").orderBy("new_position").collect()] for q in (1, 2)}
    assert got == {1: ["e3", "e2", "e1", "e4", "e5"], 2: ["a", "b"]}


def test_parsed_score(spark):
    df = spark.createDataFrame([("0.75 good",), ("1",), ("1.2",), ("9",), ("none",), ("",)], "t string")
    assert [r.v for r in df.select(cross.parsed_score("t").alias("v")).collect()] == [0.75, 1.0, 1.0, 0.0, 0.0, 0.0]


def test_caches(spark):
    now = datetime(2025, 1, 1)
    kinds = "query string, query_vector array<float>, project_id string, entry_id string, score double, cached_at timestamp"
    cache = spark.createDataFrame([("release plan blocked", [1.0, 0.0], None, "e", 0.4, now), ("old", [0.0, 1.0], None, "e", 0.9, now - timedelta(days=1))], kinds)
    asked = spark.createDataFrame([(1, "Release plan blocked", [0.0, 1.0], None, "e"), (2, "blocked plan release", [0.0, 1.0], None, "e"), (3, "else", [1.0, 0.1], None, "e"), (4, "else", [0.0, 1.0], None, "e")], "query_id long, query string, query_vector array<float>, project_id string, entry_id string")
    got = {r.query_id: (r.l1, r.l2, r.l3) for r in cross.cached(asked, cache, F.lit(now)).collect()}
    assert got[1][:2] == (0.4, 0.4) and got[2][:2] == (None, 0.4)
    assert got[3][2] == pytest.approx(0.95 / math.sqrt(1.01)) and got[4] == (None, None, None)
    metrics = cross.cache_metrics(cross.cached(asked, cache, F.lit(now))).first()
    assert metrics.pairs == 4 and metrics.hit_rate == 0.75


def test_table_operations(spark):
    table = spark.createDataFrame([("a", 1, {"x": "1"}), ("b", 2, {"y": "2"})], "id string, n int, m map<string,string>")
    new = spark.createDataFrame([("b", 9, {"z": "3"}), ("c", 3, None)], "id string, n int, m map<string,string>")
    assert {r.id: r.n for r in tables.upsert(table, new, "id").collect()} == {"a": 1, "b": 9, "c": 3}
    changed = {r.id: (r.n, r.m) for r in tables.update(table, new, "id").collect()}
    assert changed == {"a": (1, {"x": "1"}), "b": (9, {"y": "2", "z": "3"})}
    assert [r.id for r in tables.delete(table, new, "id").collect()] == ["a"]
    assert {r.id: r.n for r in tables.import_rows(table, new.withColumn("t", F.lit("x")), "id", "t").collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r.id: r.n for r in tables.import_rows(table, new.withColumn("t", F.lit("x")), "id", "t", force=True).collect()} == {"a": 1, "b": 9, "c": 3}
    assert [r.id for r in table.where(tables.matching(table, {"n": 2})).collect()] == ["b"]


def test_matching(spark):
    table = spark.createDataFrame([("a", 1, ["x", "y"], True), ("b", None, ["x"], None), ("c", 1, None, False), ("d", 2, [], None)], "id string, n int, tags array<string>, is_session_summary boolean")
    found = lambda filters: [r.id for r in table.where(tables.matching(table, filters)).orderBy("id").collect()]
    assert found({"tags": "x"}) == ["a", "b"] and found({"tags": ["x"]}) == ["b"] and found({"tags": ["y", "x"]}) == [] and found({"tags": []}) == ["d"]
    assert found({"tags": "x", "n": 1}) == ["a"] and found({"n": [1]}) == [] and found({}) == ["a", "b", "c", "d"]
    assert found({"n": {"$ne": 1}}) == ["b", "d"] and found({"tags": {"$ne": "x"}}) == ["c", "d"]
    assert tables.prepared_filters(None, None, with_summaries=True) is None
    assert found(tables.prepared_filters({"n": 1}, {"n": 2, "tags": "x"})) == [] and found(tables.prepared_filters({"n": 1})) == ["c"]


def test_bm25_from_a_stored_index(spark, tmp_path):
    rows = [(f"d{i}", " ".join(random.Random(i).choices(["queue", "stall", "Vault", "batch", "note"], k=i % 9))) for i in range(60)] + [("e", ""), ("n", None)]
    docs = spark.createDataFrame(rows, "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "vault queue queue"), (2, "nothing"), (3, None)], "query_id long, query string")
    bm25.postings(docs, "chunk_id", "content").write.parquet(f"{tmp_path}/postings")
    bm25.document_frequencies(docs, "content").write.parquet(f"{tmp_path}/frequencies")
    stored = bm25.search(docs.limit(0), asked, 10, index=spark.read.parquet(f"{tmp_path}/postings"), frequencies=spark.read.parquet(f"{tmp_path}/frequencies"))
    read = lambda df: [(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in df.orderBy("query_id", "rank").collect()]
    assert read(stored) == read(bm25.search(docs, asked, 10)) and len(read(stored)) == 10
    assert bm25.statistics(bm25.document_frequencies(docs, "content")).first().n_docs == 62
