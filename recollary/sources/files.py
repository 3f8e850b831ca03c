"""File sources and sinks: note vaults, session logs, scenarios, exports and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollary.functions import text as T

FEATURE_COLUMNS = "request_id string, method string, rank int, is_relevant int, score double, memory_id string, memory_strength double, recency double, refs_reliability double, bm25_score double, vector_similarity double, metadata_bonus double"


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, front_matter, links, conversations (user, assistant) of every *.md file below the folder.

    conversations is empty for a note without any."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified_at"), "value")
    pair = r"(?is)(?:\*\*User:\*\*|^User:|\nUser:)\s*(.+?)\s*(?:\*\*Assistant:\*\*|\nAssistant:)\s*(.+?)\s*(?=\*\*User:\*\*|\nUser:|\z)"
    users, answers = F.regexp_extract_all("value", F.lit(pair), F.lit(1)), F.regexp_extract_all("value", F.lit(pair), F.lit(2))
    talk = F.filter(F.zip_with(users, answers, lambda u, a: F.struct(u.alias("user"), a.alias("assistant"))), lambda p: (p["user"] != "") & (p["assistant"] != ""))
    return raw.select("path", "modified_at", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), T.front_matter("value").alias("front_matter"), T.wikilinks("value").alias("links"), talk.alias("conversations"))


def note_conversations(found: DataFrame) -> DataFrame:
    """One row per conversation of the notes, ready for ingest.remember()."""
    return found.select("path", "modified_at", F.explode("conversations").alias("c")).select(
        "c.user", "c.assistant", F.lit("obsidian").alias("source"), F.col("modified_at").alias("created_at"), F.lit(None).cast("string").alias("project_id"), F.array("path").alias("refs"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("doc_type")
    )


def log_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jsonl", "log", "txt"), most_bytes: int = 10_000_000) -> DataFrame:
    """path, modified_at, length of log files; hidden, temporary, empty and too large ones are left out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified_at"), "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listed.where(name.rlike(rf"(?i)\.({'|'.join(extensions)})$") & ~name.rlike(r"^[._]|\.tmp") & F.col("length").between(1, most_bytes))


def unprocessed(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Files whose path, modification time and length are not all in the checkpoint."""
    return files.join(checkpoint.select("path", "modified_at", "length").distinct(), ["path", "modified_at", "length"], "left_anti")


def payload_events(lines: DataFrame) -> DataFrame:
    """session_id, ts, role, text from lines (value, path) of {type: event_msg, payload: {type, message}}."""
    kind = F.get_json_object("value", "$.payload.type")
    role = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant")
    session = F.regexp_extract("path", r"([0-9a-fA-F]{8}-[0-9a-fA-F-]{27,})", 1)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    rows = lines.where(F.get_json_object("value", "$.type") == "event_msg")
    return rows.select(F.when(session != "", session).otherwise(stem).alias("session_id"), F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("ts"), role.alias("role"), F.get_json_object("value", "$.payload.message").alias("text")).where("role is not null and text is not null")


def message_events(lines: DataFrame) -> DataFrame:
    """session_id, ts, role, text from lines of {type: user, message: {content}} and {message: {role: assistant,
    content: text or parts}}; the text parts are joined by line ends."""
    content = F.get_json_object("value", "$.message.content")
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    said = F.when(content.rlike(r"^\s*\["), F.nullif(joined, F.lit(""))).otherwise(content)
    role = F.when(F.get_json_object("value", "$.type") == "user", "user").when(F.get_json_object("value", "$.message.role") == "assistant", "assistant")
    return lines.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("session_id"), F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("ts"), role.alias("role"), said.alias("text")).where("role is not null and text is not null")


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """value, path of every line below the folder."""
    return spark.read.text(folder, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))


def scenario(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Projects and conversations of a scenario file."""
    schema = "projects array<struct<name: string, description: string>>, conversations array<struct<user: string, assistant: string, project: string, source: string, refs: array<string>, metadata: struct<topic: string, type: string, severity: string>, timestamp: string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    talk = raw.select(F.explode("conversations").alias("c")).select("c.*")
    rows = talk.select("user", "assistant", F.coalesce("source", F.lit("scenario")).alias("source"), F.try_to_timestamp("timestamp").alias("created_at"), F.col("project").alias("project_id"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), F.col("metadata.topic").alias("topic"), F.col("metadata.type").alias("doc_type"))
    return raw.select(F.explode("projects").alias("p")).select("p.*"), rows


def export(memories: DataFrame, path: str) -> None:
    """All memories as JSON lines."""
    memories.write.mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def write_session_logs(lines: DataFrame, path: str, most_lines: int = 100_000) -> None:
    """One folder a session; a new file after most_lines lines."""
    lines.repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id").select("session_id", F.col("line").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", most_lines).partitionBy("session_id").text(path)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_COLUMNS).option("header", True).csv(path)


def last_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics object of the last line, by number, that has one."""
    lines = spark.read.schema("line_no long, metrics map<string, double>").json(path)
    return lines.where("metrics is not null").agg(F.max_by("metrics", "line_no").alias("metrics"))
