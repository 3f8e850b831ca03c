from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from recollary.operators import catalog, consolidate

NOW = datetime(2025, 6, 1)
KINDS = (
    "memory_id string, memory_type string, content string, importance double, created_at timestamp, updated_at timestamp, migrated_at timestamp, cluster_id string, "
    "cluster_size int, is_representative boolean, is_compressed boolean, compressed_at timestamp, insert_seq long"
)


def memories(spark, rows):
    made = [(m, kind, text, imp, NOW - timedelta(days=age) if age is not None else None, None, None, cluster, None, None, None, None, i) for i, (m, kind, text, imp, age, cluster) in enumerate(rows)]
    return spark.createDataFrame(made, KINDS)


def test_migrate(spark):
    df = memories(spark, [("a", "working", "", 0.5, 1, None), ("b", "working", "", 0.5, 0, None), ("c", "long_term", "", 0.5, 9, None), ("d", "working", "", 0.5, None, None), (None, "working", "", 0.5, 3, None)])
    got = [(r.memory_id, r.memory_type, r.migrated_at) for r in consolidate.migrate(df, F.lit(NOW)).orderBy("insert_seq").collect()]
    assert got == [("a", "short_term", NOW), ("b", "working", None), ("c", "long_term", None), ("d", "working", None), (None, "working", None)]


def test_forget_and_cascade(spark):
    df = memories(spark, [("old", "working", "", 0.1, 45, None), ("new", "working", "", 0.1, 5, None), ("dear", "working", "", 0.9, 45, None), ("odd", "working", "", float("nan"), 45, None), ("unknown", "working", "", None, None, None)])
    chunks = spark.createDataFrame([("c1", "old"), ("c2", "new"), ("c3", None)], "chunk_id string, memory_id string")
    kept, rest = consolidate.forget(df, chunks, F.lit(NOW))
    assert {r.memory_id for r in kept.collect()} == {"new", "dear", "odd", "unknown"}
    assert {r.chunk_id for r in rest.collect()} == {"c2", "c3"}


def test_representative_and_marks(spark):
    df = memories(spark, [("a", "working", "x" * 10, 0.5, 0, "k"), ("b", "working", "x" * 900, 0.5, 0, "k"), ("c", "working", "x", 0.5, 0, "k"), ("d", "working", "x", 0.5, 0, "single"), ("e", "working", "x", 0.5, 0, None)])
    chosen = consolidate.representatives(df, F.col("cluster_id"), F.lit(NOW))
    assert [(r.cluster, r.memory_id, r.cluster_size) for r in chosen.collect()] == [("k", "b", 3)]
    marked = {r.memory_id: (r.cluster_id, r.is_representative, r.is_compressed) for r in consolidate.mark(df, chosen, F.col("cluster_id"), F.lit(NOW)).collect()}
    assert marked["b"] == ("cluster-b", True, False) and marked["a"] == ("cluster-b", False, True) and marked["d"] == ("single", False, False)
    stats = consolidate.consolidate(df, spark.createDataFrame([], "chunk_id string, memory_id string"), F.lit(NOW), F.col("cluster_id"))[2].first()
    assert (stats.clusters, stats.clusters_created, stats.compressed, stats.forgotten) == (1, 2, 2, 0)


def test_representative_ties_go_to_the_first(spark):
    df = memories(spark, [("z", "working", "x", 0.5, 0, "k"), ("a", "working", "x", 0.5, 0, "k")])
    assert consolidate.representatives(df, F.col("cluster_id"), F.lit(NOW)).first().memory_id == "z"


def test_catalog(spark):
    projects = spark.createDataFrame([("p1", "Winter Orchard", ["Ops", "db"], 5, NOW, None), ("p2", "other", [], 0, NOW, NOW), ("p3", None, None, None, NOW, None)], "id string, name string, tags array<string>, memory_count long, created_at timestamp, last_accessed timestamp")
    assert [r.id for r in catalog.with_all_tags(projects, ["DB", "ops"]).collect()] == ["p1"]
    assert [r.id for r in catalog.with_all_tags(projects, []).collect()] == ["p2", "p1", "p3"]
    names = spark.createDataFrame([("p2",), ("WINTER-orchard",), ("123e4567-e89b-12d3-a456-426614174000",), ("nobody",), (None,)], "project_name string")
    got = {r.project_name: r.project_id for r in catalog.resolve_projects(names, projects).collect()}
    assert got == {"p2": "p2", "WINTER-orchard": "p1", "123e4567-e89b-12d3-a456-426614174000": "123e4567-e89b-12d3-a456-426614174000", "nobody": None, None: None}
    marks = spark.createDataFrame([("b1", "release plan", 2), ("b2", "release", 9), ("b3", "else", 99)], "bookmark_id string, query string, usage_count long")
    asked = spark.createDataFrame([(1, "the release plan")], "query_id long, query string")
    assert [r.bookmark_id for r in catalog.recommend(asked, marks).orderBy("rank").collect()] == ["b1", "b2"]


def test_consolidation_clusters_by_vectors(spark):
    df = memories(spark, [(i, "working", "x" * n, 0.5, 0, "stale") for i, n in [("a", 10), ("b", 900), ("c", 5), ("d", 7)]]).withColumn("insert_seq", F.ascii("memory_id").cast("long"))
    one, near, far = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 1.0, 0.0]
    chunks = spark.createDataFrame([("a-0", "a", 0, one), ("a-1", "a", 1, far), ("b-0", "b", 0, near), ("c-0", "c", 0, far), ("d-0", "d", 0, None)], "chunk_id string, memory_id string, chunk_index int, embedding array<float>")
    kept, _, stats = consolidate.consolidate(df, chunks, F.lit(NOW), size=3)
    assert (stats.first().clusters_created, stats.first().clusters, stats.first().compressed) == (2, 1, 1)
    got = {r.memory_id: (r.cluster_id, r.is_representative) for r in kept.collect()}
    assert got["a"] == got["a"][:1] + (False,) and got["b"] == ("cluster-b", True) and got["a"][0] == "cluster-b" and got["c"] == ("stale", False) and got["d"] == ("stale", False)


def shuffled(spark):
    """Bytes that the session has shuffled."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def test_consolidation_is_counted_without_moving_contents(spark, tmp_path):
    from recollary.plans import catalogue

    df = memories(spark, [(f"m{i:03d}", "working", None, 0.5, i % 50, None) for i in range(400)])
    long = F.concat_ws("", *[F.sha2(F.concat("memory_id", F.lit(f"-{k}")), 512) for k in range(100)])  # 12,800 signs
    df.withColumn("content", long).withColumn("ingested_at", F.lit(NOW)).repartition(4).write.parquet(f"{tmp_path}/memories.parquet")
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (j == F.col("insert_seq") % 64).cast("float"))
    df.select("memory_id", "insert_seq", F.concat("memory_id", F.lit("-0")).alias("chunk_id"), F.lit(0).alias("chunk_index"), vector.alias("embedding")).write.parquet(f"{tmp_path}/chunks.parquet")
    consolidate.cut(df)  # so that there is a folder for checkpoints
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved, kept = shuffled(spark), stored()
        counts = catalogue.queries()["consolidation_stats"](spark, str(tmp_path))
        assert counts.first().asDict() == {"migrated": 400, "clusters_created": 64, "clusters": 64, "compressed": 336, "forgotten": 0}
        moved, kept = shuffled(spark) - moved, stored() - kept
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < 1_000_000 and kept < 1_000_000  # the contents are 5 MB
