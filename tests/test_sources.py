import json

import pytest

from recollary.operators import ingest
from recollary.sources import files


def test_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("---\ntopic: x\n---\n**User:**\nq1\n\n**Assistant:**\na1\n\n**User:**\nq2\n\n**Assistant:**\na2 [[Link]]\n")
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "c.txt").write_text("**User:**\nno\n\n**Assistant:**\nno")
    found = files.notes(spark, str(tmp_path))
    got = {r.name: ([(c.user, c.assistant) for c in r.conversations], r.links, r.front_matter) for r in found.collect()}
    assert got == {"a": ([("q1", "a1"), ("q2", "a2 [[Link]]")], ["Link"], {"topic": "x"}), "b": ([], [], {})}
    assert files.note_conversations(found).count() == 2


def test_log_files_and_checkpoint(spark, tmp_path):
    for name, body in {"a.log": "x", "b.jsonl": "", ".hidden.log": "x", "c.bin": "x", "d.txt": "yy", "e.txt": "x" * 50}.items():
        (tmp_path / name).write_text(body)
    found = files.log_files(spark, str(tmp_path), most_bytes=10)
    assert {r.path.rsplit("/", 1)[1] for r in found.collect()} == {"a.log", "d.txt"}
    done = spark.createDataFrame(found.where("path like '%a.log'").collect(), found.schema)
    assert {r.path.rsplit("/", 1)[1] for r in files.unprocessed(found, done).collect()} == {"d.txt"}


def test_event_logs(spark, tmp_path):
    payloads = [{"type": "event_msg", "timestamp": "2025-01-01T00:00:00Z", "payload": {"type": "user_message", "message": "hi"}}, {"type": "event_msg", "payload": {"type": "token_count"}}, {"type": "other"}]
    messages = [{"type": "user", "timestamp": "2025-01-01T00:00:01Z", "message": {"content": "ask"}}, {"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}]}}, {"message": {"role": "assistant", "content": "plain"}}]
    (tmp_path / "x").mkdir()
    (tmp_path / "y").mkdir()
    (tmp_path / "x" / "rollout-123e4567-e89b-12d3-a456-426614174000.jsonl").write_text("\n".join(map(json.dumps, payloads)) + "\nbroken {")
    (tmp_path / "y" / "session1.jsonl").write_text("\n".join(map(json.dumps, messages)))
    got = files.payload_events(files.log_lines(spark, str(tmp_path / "x"))).collect()
    assert [(r.session_id, r.role, r.text) for r in got] == [("123e4567-e89b-12d3-a456-426614174000", "user", "hi")]
    got = files.message_events(files.log_lines(spark, str(tmp_path / "y"))).collect()
    assert [(r.session_id, r.role, r.text) for r in got] == [("session1", "user", "ask"), ("session1", "assistant", "a\nb"), ("session1", "assistant", "plain")]


def test_scenario_and_features(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"projects": [{"name": "p", "description": "d"}], "conversations": [{"user": "u", "assistant": "a", "source": None, "metadata": {"topic": "t"}, "timestamp": "2025-11-08T22:50:00"}]}))
    projects, talk = files.scenario(spark, str(tmp_path / "s.json"))
    assert projects.first().name == "p"
    row = talk.first()
    assert (row.source, row.topic, row.refs, row.created_at.hour) == ("scenario", "t", [], 22)
    rows = spark.createDataFrame([("r", "m", 1, 1, 0.5, "mem", 1.0, 0.5, 0.0, 1.0, 0.4, 0.0)], files.FEATURE_COLUMNS)
    files.write_features(rows, str(tmp_path / "f"))
    assert files.read_features(spark, str(tmp_path / "f")).collect() == rows.collect()
    files.export(rows, str(tmp_path / "e"))
    assert files.read_export(spark, str(tmp_path / "e"), rows).collect() == rows.collect()
    (tmp_path / "m.jsonl").write_text('{"line_no": 1, "metrics": {"p": 0.5}}\n{"line_no": 2}\n{"line_no": 3, "metrics": {"p": 0.7}}')
    assert files.last_metrics(spark, str(tmp_path / "m.jsonl")).first().metrics == {"p": 0.7}


def test_chunker():
    text = "# One\n\n" + "word " * 60 + "\n\n```\n# not a heading\n\n" + "code " * 10 + "\n```\n\n## Two\n\n" + "Sentence here. " * 60
    made = ingest.chunk(text, 50, 5)
    assert len(made) > 3 and [i for i, _ in made] == sorted({i for i, _ in made})
    assert any("# not a heading" in c and c.count("```") == 2 for _, c in made)
    assert "".join("".join(c.split()) for _, c in made) == "".join(text.split())
    assert ingest.chunk("", 50) == [] and ingest.chunk("short", 50) == [(0, "short")]


def test_long_pieces():
    text = "\n".join("x" * 50 for _ in range(200))
    made = ingest.long_pieces(text)
    assert all(len(p) <= 3500 for p in made) and made[0].endswith("\n")
    assert made[1].startswith(made[0][-200:])


def test_remember(spark):
    from pyspark.sql import functions as F

    kinds = "user string, assistant string, source string, created_at timestamp, project_id string, refs array<string>, topic string, doc_type string"
    rows = [("q", "a bug", "chat", None, None, None, None, None), ("q", "a bug", "chat", None, None, None, None, None), ("", "a", "chat", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    made, bad = ingest.remember(spark.createDataFrame(rows, kinds), F.lit("2025-01-01").cast("timestamp"))
    got = made.collect()
    assert len(got) == 1 and bad.count() == 2
    assert (got[0].schema_type, got[0].memory_type, got[0].importance, got[0].created_at.year) == ("Incident", "working", 0.5, 2025)
    assert got[0].entry_id == got[0].memory_id + "-metadata"
    chunks = ingest.chunks(made).collect()
    assert [(c.chunk_id, c.chunk_index) for c in chunks] == [(f"{got[0].memory_id}-chunk-0", 0)]
    assert chunks[0].salience_weight == pytest.approx(0.5 + 0.45 * chunks[0].tokens / 256)
