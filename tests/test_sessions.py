import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recollary.operators import sessions
from recollary.sources.tail import TailSource
from recollary.streaming import live

T0 = datetime(2025, 1, 1)
KINDS = "event_id long, session_id string, ts timestamp, received_at timestamp, role string, command string, output string, exit_code int, metadata map<string,string>"


def event(i, seconds, session="s", text="x", role="user", **metadata):
    at = T0 + timedelta(seconds=seconds) if seconds is not None else None
    return (i, session, at, at, role, text if role == "user" else None, text if role != "user" else None, 0, metadata)


def test_gap_is_exact_and_crosses_buckets(spark):
    times = [0, 600, 1201, 21_590, 21_610, None]  # 600 keeps a session open, 601 ends it; the last two lie in two buckets
    df = spark.createDataFrame([event(i, t) for i, t in enumerate(times)], KINDS)
    got = [(r.started_at, r.events) for r in sessions.idle_sessions(df).orderBy("started_at").collect()]
    assert got == [(T0, 2), (T0 + timedelta(seconds=1201), 1), (T0 + timedelta(seconds=21_590), 2)]


def test_message_ttl(spark):
    df = spark.createDataFrame([event(1, 0), event(2, 10), event(3, 3611), event(4, 0, text="y")], KINDS)
    assert {r.event_id for r in sessions.distinct_messages(df).collect()} == {1, 3, 4}


def test_message_ttl_counts_from_the_last_kept(spark):
    rows = [event(i, 1800 * i) for i in range(6)] + [event(10 + i, 600 * i, text="z") for i in range(40)] + [event(90, None), event(91, None), event(7, 0)]
    got = sorted(r.event_id for r in sessions.distinct_messages(spark.createDataFrame(rows, KINDS)).collect())
    assert got == [0, 2, 4, 10, 16, 22, 28, 34, 40, 46, 90, 91]


def test_message_ttl_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [event(i, rng.randint(0, 90_000), text=rng.choice("abc")) for i in range(400)]
    kept, want = {}, set()
    for e in sorted(rows, key=lambda e: (e[2], e[0])):
        last = kept.get(e[5])
        if last is None or (e[2] - last).total_seconds() >= 3600:
            kept[e[5]] = e[2]
            want.add(e[0])
    assert {r.event_id for r in sessions.distinct_messages(spark.createDataFrame(rows, KINDS)).collect()} == want


def test_long_sessions_are_cut_into_parts(spark):
    from recollary.operators import ingest

    df = spark.createDataFrame([event(i, i * 20) for i in range(25)] + [event(100, 5000)], KINDS)
    inside = sessions.idle_runs(df)
    assert {(r.event_id, r.run_started) for r in inside.collect()} == {(i, T0) for i in range(25)} | {(100, T0 + timedelta(seconds=5000))}
    runs = inside.withColumn("session_id", F.concat("session_id", F.lit("@"), F.unix_micros("run_started")))
    talk = ingest.session_conversations(sessions.log_lines(runs), sessions.summaries(runs), most=10).collect()
    assert sorted(r.assistant.count("**User:**") for r in talk) == [1, 5, 10, 10] and len({r.refs[0] for r in talk}) == 2 and len({r.user for r in talk}) == 4


def test_hints(spark):
    rows = [event(1, 0, cwd="/srv/a"), event(2, 1, cwd="/srv/b/"), event(3, 2, project_id="p"), event(4, 3, project_id="q"), event(5, 0, session="t")]
    got = {r.session_id: (r.project_hint, r.confidence) for r in sessions.hints(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == {"s": ("p", 0.9)}


def test_once_and_late(spark):
    early = event(1, 0)
    late = early[:3] + (T0 + timedelta(hours=2),) + early[4:]
    df = spark.createDataFrame([late, early, event(2, 5)], KINDS)
    assert sessions.once(df).count() == 2
    assert sessions.late(spark.createDataFrame([late], KINDS)).first().n_late == 1


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streaming_equals_batch(spark, tmp_path):
    times = [0, 100, 700, 2000, 2500, 9000, 40_000, 90_000]
    df = spark.createDataFrame([event(i, t, text=f"m{i % 3}") for i, t in enumerate(times)], KINDS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = {(r.started_at, r.events) for r in sessions.idle_sessions(df).collect()}
    got = {(r.started_at, r.events) for r in run(live.idle_sessions(stream), "idle", tmp_path).collect()}
    assert got == {x for x in batch if x[0] < T0 + timedelta(seconds=80_000)}  # the last session is still open
    kept = {r.event_id for r in run(live.distinct_messages(stream), "distinct", tmp_path).collect()}
    assert kept <= set(range(8)) and {0, 1} <= kept


def test_streaming_hints(spark, tmp_path):
    rows = [("s", T0 + timedelta(seconds=i), h, c, f) for i, (h, c, f) in enumerate([("a", 0.6, False), ("b", 0.6, False), ("c", 0.9, False), (None, 0.0, True), ("d", 0.6, False)])]
    df = spark.createDataFrame(rows, "session_id string, ts timestamp, hint string, confidence double, forced boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "hints_in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "hints_in"))
    got = [(r.project_hint, r.confidence) for r in run(live.hints(stream), "hints", tmp_path).collect()]
    assert got == [("a", 0.6), ("c", 0.9), (None, 0.0), ("d", 0.6)]


def test_retry_jobs(spark):
    jobs = spark.createDataFrame([("a", T0, 0, T0), ("b", T0, 1, T0), ("c", T0, 3, T0), ("d", T0, 0, T0)], "job_id string, queued_at timestamp, retry_count int, not_before timestamp")
    results = spark.createDataFrame([("a", True, T0), ("b", False, T0), ("c", False, T0)], "job_id string, ok boolean, at timestamp")
    got = {r.job_id: (r.retry_count, r.not_before) for r in live.retry_jobs(jobs, results).collect()}
    assert got == {"b": (2, T0 + timedelta(seconds=4)), "d": (0, T0)}


def test_tail_source_follows_appended_lines(spark, tmp_path):
    spark.dataSource.register(TailSource)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\npart")
    stream = spark.readStream.format("tail").option("path", str(folder)).load()
    query = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "tail")).start()

    def wait(n):
        for _ in range(120):
            if spark.table("tailed").count() >= n:
                break
            time.sleep(0.5)
        return [r.value for r in spark.table("tailed").collect()]

    try:
        assert wait(2) == ["one", "two"]
        with (folder / "a.log").open("a") as f:
            f.write("ial\nthree\n")
        assert sorted(wait(4)) == ["one", "partial", "three", "two"]
    finally:
        query.stop()


def test_tail_reads_lines_by_line_feeds_only(tmp_path):
    from recollary.sources.tail import Span, TailReader

    path = tmp_path / "a.log"
    path.write_bytes("one\u2028still one\x0c\r\ntwo\n\nthree".encode())
    reader = TailReader(str(tmp_path))
    (span,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [v for _, v in reader.read(span)] == ["one\u2028still one\x0c", "two", ""]
    assert list(reader.read(Span(str(path), 0, 0))) == []
