import numpy as np
from pyspark.sql import functions as F

from recollary.llm import graph


def groups(n, size, seed, noise=0.1):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(n // 5, size)), 5, axis=0) + rng.normal(scale=noise, size=(n // 5 * 5, size))
    return x.astype(np.float32)


def brute(x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s.round(9), axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in best[i] if s[i, j] >= least}


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>")


def test_recall_against_brute_force(spark):
    x = groups(3000, 64, 1)
    want = brute(x, 5, 0.9)
    got = {(r.chunk_id, r.neighbour) for r in graph.most_similar(frame(spark, x), min_similarity=0.9).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_recall_without_bound(spark):
    x = groups(600, 16, 2, 0.3)
    want = brute(x, 5, -2)
    got = {(r.chunk_id, r.neighbour) for r in graph.most_similar(frame(spark, x), size=16, shards=4, degree=24, beam=48, cell=128).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_every_chunk_gets_its_neighbours(spark, tmp_path):
    from recollary.llm import queries

    x = np.random.default_rng(8).normal(size=(700, 64)).astype(np.float32)  # nothing is near anything
    rows = [(f"c{i:03}", v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "chunk_id string, embedding array<float>").write.parquet(f"{tmp_path}/chunks.parquet")
    got = queries.p2_neighbours(spark, str(tmp_path)).toPandas()
    assert (got.groupby("chunk_id").size() == 5).all() and got["chunk_id"].nunique() == 700
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    want = {(f"c{i:03}", f"c{j:03}") for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    assert len(want & set(zip(got["chunk_id"], got["neighbour"]))) >= 0.9 * len(want)
    assert queries.p2_found(spark, str(tmp_path)).count() == 0


def test_large_cells_are_split_and_searched_whole(spark):
    x = groups(1500, 64, 3)
    got = {(r.chunk_id, r.neighbour) for r in graph.most_similar(frame(spark, x), min_similarity=0.9, cell=10_000, max_shard=200).collect()}
    want = brute(x, 5, 0.9)
    assert len(got & want) >= 0.98 * len(want)


def test_a_dense_clump_holds_a_third(spark):
    """A third of all vectors lie together: no task gets more than max_shard, and nothing is lost."""
    rng = np.random.default_rng(4)
    clump = rng.normal(size=64) + rng.normal(scale=0.02, size=(500, 64))
    x = np.concatenate((clump, groups(1000, 64, 5))).astype(np.float32)
    got = {(r.chunk_id, r.neighbour) for r in graph.most_similar(frame(spark, x), min_similarity=0.9, cell=100, max_shard=150, degree=24, beam=48).collect()}
    want = brute(x, 5, 0.9)
    assert len(got & want) >= 0.95 * len(want)


def test_two_levels_of_cells(spark):
    x = groups(2000, 64, 6)
    want = brute(x, 5, 0.9)
    got = {(r.chunk_id, r.neighbour) for r in graph.most_similar(frame(spark, x), min_similarity=0.9, cell=100, top_cells=4).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got & want) >= 0.98 * len(got)


def test_copies_ties_and_unusable(spark):
    one, two = [1.0] * 64, [1.0] * 32 + [-1.0] * 32
    rows = [(f"c{i}", one) for i in range(9)] + [("c0", one), ("d", two), ("e", [2.0] * 64), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0]), ("none", None), ("hole", [None] + [1.0] * 63), (None, one)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("print", F.lit("x"))
    got = {}
    for r in graph.most_similar(df, min_similarity=0.9).collect():
        got.setdefault(r.chunk_id, []).append((r.rank, r.neighbour))
    assert [n for _, n in sorted(got["c0"])] == ["c1", "c2", "c3", "c4", "c5"]
    assert [n for _, n in sorted(got["c8"])] == ["c0", "c1", "c2", "c3", "c4"]
    assert [n for _, n in sorted(got["e"])] == ["c0", "c1", "c2", "c3", "c4"]
    assert set(got) == {*(f"c{i}" for i in range(9)), "e"}


def test_empty_and_single(spark):
    kinds = "chunk_id string, embedding array<float>"
    assert graph.most_similar(spark.createDataFrame([], kinds)).count() == 0
    assert graph.most_similar(spark.createDataFrame([("a", [1.0] * 64)], kinds)).count() == 0


def test_prune_keeps_diverse_edges():
    x = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1]], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = graph.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1]]), degree=3, alpha=1.2)
    assert kept.tolist() == [[1, 3, -1]]  # 2 is much nearer to 1 than to 0


def test_searches_compare_no_pair_twice(monkeypatch):
    """Products made in a search: about 145 a query from its own place; 307 when rows were filled up to equal lengths."""
    x = groups(770, 64, 9)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = graph.build(x)
    made = []
    for name in ("matmul", "einsum"):
        real = getattr(np, name)

        def counted(*args, real=real, **more):
            out = real(*args, **more)
            made.append(out.size)
            return out

        monkeypatch.setattr(np, name, counted)
    ids, sims = graph.beam_search(x, edges, np.arange(len(x))[:, None], x)
    assert 24 * len(x) < sum(made) < 200 * len(x)
    got = {(i, int(j)) for i, row in enumerate(ids) for j, sim in zip(row, sims[i]) if j != i and sim >= 0.9}
    want = brute(x, 5, 0.9)
    assert len(got & want) >= 0.98 * len(want)


def test_a_row_of_points_ends_in_its_own_neighbours():
    """Beams hold no point twice, best first, and graphs of any small size link all their points."""
    for n in (1, 2, 3, 17, 30, 511, 512, 513, 700):
        x = groups(705, 16, n, 0.5)[:n]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        edges = graph.build(x, degree=8, beam=12)
        assert edges.shape == (n, 8) and ((edges >= -1) & (edges < n)).all() and (edges != np.arange(n)[:, None]).all()
        ids, sims = graph.beam_search(x, edges, np.arange(n)[:, None], x, 12)
        assert (np.diff(sims, axis=1) <= 0).all() and ((ids >= 0).sum(axis=1) >= min(n, 6)).all()
        for row, sim, v in zip(ids, sims, x):
            kept = row[row >= 0]
            assert len(set(kept.tolist())) == len(kept)
            assert np.allclose(x[kept] @ v, sim[: len(kept)], atol=1e-5)


def test_nearest_cells():
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(1500, 8)).astype(np.float32), rng.normal(size=(40, 8)).astype(np.float32)
    for number in (1, 3, 40):
        want = np.argsort(-(x @ centres.T), axis=1)[:, :number]
        assert (graph.nearest_cells(x, centres, number) == want).all()
    assert graph.nearest_cells(x[:0], centres, 3).shape == (0, 3)
