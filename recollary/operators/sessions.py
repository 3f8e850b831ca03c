"""Sessions of an event log, as batch transforms. The streaming module applies the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollary.functions.text import message_key


def once(events: DataFrame) -> DataFrame:
    """Each event as first received."""
    first = events.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), "received_at").alias("e"))
    return first.select("event_id", "e.*")


def idle_runs(events: DataFrame, gap_seconds: int = 600, bucket_seconds: int = 21_600, key: str = "session_id") -> DataFrame:
    """The events that have a time, with run_started: the start of the run of events with no pause longer than
    the gap that each is in. In two levels as idle_sessions, so events meet only rows of their own bucket."""
    limit = gap_seconds * 1_000_000
    t = F.unix_micros("ts")
    timed = events.where(F.col("ts").isNotNull()).withColumn("_bucket", F.floor(t / (bucket_seconds * 1_000_000)))
    inside = Window.partitionBy(key, "_bucket").orderBy("ts")
    opened = timed.withColumn("_new", (F.coalesce(t - F.unix_micros(F.lag("ts").over(inside)), F.lit(limit + 1)) > limit).cast("int"))
    placed = opened.withColumn("_run", F.sum("_new").over(inside)).drop("_new")
    runs = placed.groupBy(key, "_bucket", "_run").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    across = Window.partitionBy(key).orderBy("_a")
    new = F.coalesce(F.unix_micros("_a") - F.unix_micros(F.lag("_b").over(across)), F.lit(limit + 1)) > limit
    started = runs.withColumn("_new", new).withColumn("run_started", F.max(F.when(F.col("_new"), F.col("_a"))).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    names = started.select(F.col(key).alias("_key"), F.col("_bucket").alias("_in"), F.col("_run").alias("_no"), "run_started")
    met = placed.join(names, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_in")) & (F.col("_run") == F.col("_no")))
    return met.select(*events.columns, "run_started")


def idle_sessions(events: DataFrame, gap_seconds: int = 600, bucket_seconds: int = 21_600, key: str = "session_id") -> DataFrame:
    """key, started_at, ended_at, events: runs of events with no pause longer than the gap.

    In two levels, so that one long session does not become one task: runs inside each time bucket first,
    then only those runs, not the events, are joined across buckets. Events without a time are left out."""
    bucket = F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000))
    limit = gap_seconds * 1_000_000
    timed = events.where(F.col("ts").isNotNull()).select(key, F.unix_micros("ts").alias("t"), bucket.alias("bucket"))
    inside = Window.partitionBy(key, "bucket").orderBy("t")
    opened = timed.withColumn("new", (F.coalesce(F.col("t") - F.lag("t").over(inside), F.lit(limit + 1)) > limit).cast("int"))
    runs = opened.withColumn("run", F.sum("new").over(inside)).groupBy(key, "bucket", "run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    across = Window.partitionBy(key).orderBy("a")
    joined = runs.withColumn("new", (F.coalesce(F.col("a") - F.lag("b").over(across), F.lit(limit + 1)) > limit).cast("int"))
    whole = joined.withColumn("session", F.sum("new").over(across)).groupBy(key, "session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("events"))
    return whole.select(key, F.timestamp_micros("a").alias("started_at"), F.timestamp_micros("b").alias("ended_at"), "events")


def text_of(role: Column | None = None) -> Column:
    return F.coalesce("command", "output", F.lit(""))


def routed(events: DataFrame) -> DataFrame:
    """Adds spoken: command for the user's turns, output for the assistant's, other for the rest."""
    return events.withColumn("spoken", F.when(F.col("role") == "user", "command").when(F.col("role") == "assistant", "output").otherwise("other"))


def distinct_messages(events: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Events without those whose message (session, role, text) was kept less than ttl earlier.

    A message that keeps coming is kept again once ttl has passed since its last kept copy. Of equal times the
    smallest event_id is kept; events without a time are all kept. A message that pauses for ttl starts afresh,
    so only the times of chains without such a pause are walked, in order and one at a time, whatever their
    number; the pauses are found in buckets of one ttl, so a message said very often is not one task."""
    limit = ttl_seconds * 1_000_000
    keyed = events.withColumn("message_key", message_key("session_id", "role", text_of()))
    times = keyed.where("ts is not null").groupBy("message_key", F.unix_micros("ts").alias("t")).agg(F.min("event_id").alias("event_id"))
    placed = times.withColumn("b", F.floor(F.col("t") / limit))
    # what came before is in the same bucket or in the one before, or it is longer ago than ttl
    last = placed.groupBy("message_key", (F.col("b") + 1).alias("b")).agg(F.max("t").alias("last"))
    inside = Window.partitionBy("message_key", "b").orderBy("t")
    aged = placed.withColumn("same", F.lag("t").over(inside)).join(last, ["message_key", "b"], "left")
    opened = aged.withColumn("open", F.coalesce(F.col("t") - F.coalesce("same", "last") >= limit, F.lit(True)))
    upto = F.max(F.when(F.col("open"), F.col("t")))
    own = opened.withColumn("own", upto.over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    carried = opened.groupBy("message_key", "b").agg(upto.alias("chain")).withColumn("chain", F.max("chain").over(Window.partitionBy("message_key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    chained = own.join(carried, ["message_key", "b"]).select("message_key", F.coalesce("own", "chain").alias("chain"), "t", "event_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kept = None, 0
        for batch in batches:
            keep = []
            for key, chain, t in zip(batch["message_key"].to_pylist(), batch["chain"].to_pylist(), batch["t"].to_pylist()):
                good = (key, chain) != of or t - kept >= limit
                of = (key, chain)
                kept = t if good else kept
                keep.append(good)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = chained.repartition("message_key", "chain").sortWithinPartitions("message_key", "chain", "t")
    kept = ordered.mapInArrow(walk, chained.schema).select("message_key", "t", F.col("event_id").alias("_id"))
    timed = keyed.withColumn("t", F.unix_micros("ts")).join(kept, ["message_key", "t"]).where(F.col("event_id").eqNullSafe(F.col("_id")))
    return timed.select(*events.columns, "message_key").unionByName(keyed.where("ts is null"))


def hints(events: DataFrame) -> DataFrame:
    """session_id, project_hint, confidence: of the events' hints the most confident, the first among equals.

    A hint is metadata project_name (0.95), project_id (0.9) or the last part of cwd (0.6). By partial
    aggregation: a later hint only wins if strictly more confident."""
    get = lambda k: F.nullif(F.trim(F.try_element_at("metadata", F.lit(k))), F.lit(""))
    named, by_id, cwd = get("project_name"), get("project_id"), F.nullif(F.regexp_extract(get("cwd"), r"([^/]+)/*$", 1), F.lit(""))
    hint = F.coalesce(named, by_id, cwd)
    confidence = F.when(named.isNotNull(), 0.95).when(by_id.isNotNull(), 0.9).when(cwd.isNotNull(), 0.6)
    best = F.min(F.struct((-confidence).alias("c"), "ts", "event_id", hint.alias("hint")))
    rows = events.withColumn("hint", hint).where("hint is not null").drop("hint")
    return rows.groupBy("session_id").agg(best.alias("b")).select("session_id", F.col("b.hint").alias("project_hint"), (-F.col("b.c")).alias("confidence"))


def summaries(events: DataFrame) -> DataFrame:
    """session_id, n_commands, n_outputs, failures, started_at, ended_at, seconds of each session."""
    return events.groupBy("session_id").agg(
        F.count_if(F.col("command").isNotNull()).alias("n_commands"),
        F.count_if(F.col("output").isNotNull()).alias("n_outputs"),
        F.count_if(F.col("exit_code") != 0).alias("failures"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("seconds"),
    )


def log_lines(events: DataFrame, longest: int = 1000) -> DataFrame:
    """session_id, event_id, ts, line: the Markdown line of each event, long outputs cut as in a session log.

    The log is this table in order of ts and event_id; it is never gathered into one value."""
    said = F.coalesce("command", "output", F.lit(""))
    cut = F.when(F.length(said) > longest, F.concat(F.substring(said, 1, longest), F.lit("..."))).otherwise(said)
    who = F.when(F.col("command").isNotNull(), "**User:**").otherwise("**Assistant:**")
    return events.select("session_id", "event_id", "ts", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), who, cut).alias("line"))


def late(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """session_id, n_events, n_late, worst_delay (seconds) between happening and being received."""
    delay = (F.unix_micros("received_at") - F.unix_micros("ts")) / 1e6
    return events.groupBy("session_id").agg(F.count("*").alias("n_events"), F.count_if(delay > seconds).alias("n_late"), F.max(delay).alias("worst_delay"))


def prefetch_queries(hinted: DataFrame, configured: list[str], done: DataFrame, least: float = 0.75, most: int = 5) -> DataFrame:
    """session_id, query of what to run ahead for sessions with a sure project that were not served yet.

    hinted: session_id, project_hint, confidence, project_id. done: session_id, project_id. The project's label
    comes first, then the configured queries; blanks and repeats are left out."""
    due = hinted.where((F.col("confidence") >= least) & F.col("project_id").isNotNull()).join(done, ["session_id", "project_id"], "left_anti")
    asked = F.transform(F.array("project_hint", *map(F.lit, configured)), lambda x: F.trim(x))
    kept = F.slice(F.array_distinct(F.filter(asked, lambda q: q != "")), 1, most)
    return due.select("session_id", F.explode(kept).alias("query"))


def active(events: DataFrame, as_of: Column, idle_seconds: int = 600) -> DataFrame:
    """session_id, last_activity of the sessions that are not idle for longer."""
    last = events.groupBy("session_id").agg(F.max("ts").alias("last_activity"))
    return last.where((F.unix_micros(as_of) - F.unix_micros("last_activity")) / 1e6 <= idle_seconds)
