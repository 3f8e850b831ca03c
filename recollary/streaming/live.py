"""Structured Streaming over session events, with the same rules as the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollary.functions.text import message_key
from recollary.operators.sessions import text_of


def distinct_messages(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Events whose message (session, role, text) did not come within ttl before."""
    keyed = events.withColumn("message_key", message_key("session_id", "role", text_of()))
    return keyed.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["message_key"])


def idle_sessions(events: DataFrame, gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """session_id, started_at, ended_at (last event plus gap), events of sessions closed by the watermark."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), "session_id")
        .agg(F.count("*").alias("events"))
        .select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")
    )


def counts_by_window(events: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """Events by kind in tumbling windows, or sliding ones."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started_at"), kind, "n")


def hints(events: DataFrame) -> DataFrame:
    """session_id, project_hint, confidence each time a session's hint rises.

    events: session_id, ts, hint, confidence, forced. A hint is taken if strictly more confident than the
    held one, or forced; forced with a null hint clears it."""

    def rise(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hint, confidence = state.get if state.exists else (None, 0.0)
        for batch in batches:
            for row in batch.sort_values("ts", kind="stable").itertuples(index=False):
                if row.forced:
                    hint, confidence = row.hint, 0.0 if row.hint is None else max(row.confidence, 0.01)
                elif row.hint is not None and row.confidence > confidence:
                    hint, confidence = row.hint, row.confidence
                else:
                    continue
                yield pd.DataFrame({"session_id": [key[0]], "project_hint": [hint], "confidence": [confidence]})
        state.update((hint, confidence))

    return events.groupBy("session_id").applyInPandasWithState(rise, "session_id string, project_hint string, confidence double", "hint string, confidence double", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives every micro-batch to handle until the input is used up."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_jobs(jobs: DataFrame, results: DataFrame, most: int = 3) -> DataFrame:
    """The job table after a round: done jobs leave, failed ones wait 2^n seconds, and give up after most tries.

    jobs: job_id, queued_at, retry_count, not_before. results: job_id, ok, at."""
    joined = jobs.join(results, "job_id", "left")
    again = F.col("retry_count") + 1
    wait = F.timestamp_micros(F.unix_micros("at") + F.pow(F.lit(2.0), again).cast("long") * 1_000_000)
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    kept = joined.where(~F.coalesce("ok", F.lit(False)) & ~(failed & (F.col("retry_count") >= most)))
    return kept.select("job_id", "queued_at", F.when(failed, again).otherwise(F.col("retry_count")).alias("retry_count"), F.when(failed, wait).otherwise(F.col("not_before")).alias("not_before"))
