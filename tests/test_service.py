from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollary import plugins
from recollary.operators import evaluate, ingest, sessions
from recollary.service import METHODS, RequestError, Service, dispatch

NOW = datetime(2025, 6, 1)
TALK = "user string, assistant string, source string, created_at timestamp, project_id string, refs array<string>, topic string, doc_type string"
MEMORY = "memory_id string, entry_id string, schema_type string, memory_type string, content string, summary string, strength double, importance double, project_id string, source string, topic string, doc_type string, severity string, language string, refs array<string>, created_at timestamp, updated_at timestamp, migrated_at timestamp, cluster_id string, cluster_size int, is_representative boolean, is_compressed boolean, compressed_at timestamp, insert_seq long"
CHUNK = "chunk_id string, memory_id string, chunk_index int, content string, tokens int, salience_weight double, embedding array<float>, source string, created_at timestamp"
EVENT = "event_id long, session_id string, ts timestamp, received_at timestamp, role string, command string, output string, exit_code int, metadata map<string,string>"


@pytest.fixture
def service(spark):
    empty = lambda s: spark.createDataFrame([], s)
    start = Service(empty(MEMORY), empty(CHUNK), empty("id string, name string, tags array<string>, created_at timestamp, last_accessed timestamp"), empty("bookmark_id string, query string, usage_count long, last_used timestamp"), empty(EVENT), F.lit(NOW))
    talk = [("Why does the queue stall?", "A worker crash.", "chat", NOW, "p1", None, "queue", None), ("How is bread made?", "With flour.", "chat", NOW, "p2", None, None, None), ("What about rain?", "It falls on fields.", "chat", NOW, None, None, None, None), ("Which tool is best?", "A hammer helps.", "chat", NOW, None, None, None, None)]
    service = start.ingest_conversation(spark.createDataFrame(talk, TALK))
    return service.create_project(spark.createDataFrame([("p1", "Queue Work", None, NOW, None), ("p2", "Bread", None, NOW, NOW)], start.projects.schema))


def ask(spark, text, project=None):
    return spark.createDataFrame([(1, text, 3, project)], "query_id long, query string, top_k int, project_name string")


def test_ingest_and_search(spark, service):
    assert service.index_stats().first().asDict() == {"memories": 4, "chunks": 4, "projects": 2}
    best = service.search_memory(ask(spark, "queue stall?")).orderBy("position").first()
    memory = service.memories.where("topic = 'queue'").first()
    assert best.memory_id == memory.memory_id and memory.schema_type == "Incident"
    row = service.get_memory(memory.entry_id).first()
    assert [c.chunk_index for c in row.chunks] == [0]
    assert service.get_memory("nobody").count() == 0 and service.list_recent_memories(2).count() == 2
    assert service.list_recent_memories(9, {"project_id": "p2"}).count() == 1
    found = service.search_in_project(ask(spark, "queue stall?", "queue-work")).collect()
    assert memory.memory_id in {r.memory_id for r in found}


def test_projects_and_bookmarks(spark, service):
    again = service.create_project(spark.createDataFrame([("p9", "BREAD", None, NOW, None)], service.projects.schema))
    assert again.projects.count() == 2 and [r.id for r in service.list_projects().collect()] == ["p2", "p1"]
    assert service.get_project("queue work").first().id == "p1" and service.delete_project("p1").projects.count() == 1
    marked = service.create_bookmark(spark.createDataFrame([("b", "queue stall?", 1, None)], service.bookmarks.schema))
    used, results = marked.use_bookmark(spark.createDataFrame([("b", NOW), ("b", NOW)], "bookmark_id string, used_at timestamp"))
    assert used.list_bookmarks().first().usage_count == 3 and results.count() >= 1


def test_sessions(spark, service):
    events = [(1, "s", NOW, NOW, "user", "ls", None, 0, {"cwd": "/srv/bread"}), (2, "s", NOW, NOW, "assistant", None, "ok", 0, {})]
    live = service.add_command(spark.createDataFrame(events, EVENT))
    assert live.session_get_hint().first().project_hint == "bread"
    assert live.session_clear_project("s").session_get_hint().count() == 0
    done = live.end_session("s")
    assert done.session_events.count() == 0 and done.memories.where("source = 'session'").first().refs == ["session://s"]
    hinted = live.session_get_hint().withColumn("project_id", F.lit("p2"))
    none = spark.createDataFrame([], "session_id string, project_id string")
    assert [r.query for r in sessions.prefetch_queries(hinted, ["status", " ", "bread"], none, least=0.5).collect()] == ["bread", "status"]
    assert sessions.prefetch_queries(hinted, ["status"], none).count() == 0
    assert sessions.active(live.session_events, F.lit(NOW)).count() == 1


def test_consolidate(spark, service):
    after, stats = service.consolidate_memories()
    assert stats.first().forgotten == 0 and after.memories.count() == 4


def test_dispatch(service):
    assert dispatch(service, {"jsonrpc": "2.0", "method": "index_stats"})().count() == 1
    for request, code in (({}, -32600), ({"jsonrpc": "2.0", "method": "nothing"}, -32601), ({"jsonrpc": "2.0", "method": "get_memory", "params": []}, -32602)):
        with pytest.raises(RequestError) as error:
            dispatch(service, request)
        assert error.value.code == code
    assert {"ingest_conversation", "search_memory", "get_memory", "list_recent_memories", "consolidate_memories", "start_session", "end_session", "add_command", "session_get_hint", "session_set_project", "session_clear_project", "create_project", "list_projects", "get_project", "delete_project", "search_in_project", "create_bookmark", "list_bookmarks", "use_bookmark"} <= set(METHODS)


def test_plugins_and_summaries(spark):
    df = spark.createDataFrame([("a", "x" * 10), ("b", "line\n" * 1000), ("c", None)], "id string, t string")
    shorten = lambda c: F.concat(F.substring(c, 1, 3), F.lit("|"))
    got = {r.id: r.summary for r in ingest.summarise_long(df, "id", "t", shorten).collect()}
    assert got == {"a": "xxx|", "b": "lin|", "c": "|"}
    v = df.select(plugins.toy_embedding(F.col("t"), 4).alias("v")).first().v
    assert len(v) == 4 and v[1] > v[0]
    assert df.select(plugins.route(F.lit("ja")).alias("r")).first().r == "local"


def test_operational_metrics(spark):
    df = spark.createDataFrame([("q", i, 1.0 if i < 50 else 2.0) for i in range(100)], "g string, i int, v double")
    assert evaluate.degradation(df, "v", "i", ["g"]).first().change == 1.0
    calls = spark.createDataFrame([("local", 1, 0.5), ("local", 2, 1.5)], "target string, at int, latency double")
    row = evaluate.routing_metrics(calls, ["target"]).first()
    assert (row.calls, row.total, row.longest, row.latest, row["mean"]) == (2, 2.0, 1.5, 1.5, 1.0)
    jobs = spark.createDataFrame([(0,), (1,), (3,)], "retry_count int")
    assert tuple(evaluate.queue_stats(jobs).first()) == (2, 1, 4)
    metrics, floors = spark.createDataFrame([("p", 0.9)], "metric string, value double"), spark.createDataFrame([("p", 0.8), ("q", 0.1)], "metric string, floor double")
    assert {r.metric: r.passed for r in evaluate.gate(metrics, floors).collect()} == {"p": True, "q": False}
