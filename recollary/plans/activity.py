"""Session queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollary.operators import ingest, sessions
from recollary.plans import base
from recollary.plans.registry import EVENT, query
from recollary.session import load


@query(f"""WITH {EVENT}, o AS (SELECT session_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts), 600000001) > 600000000 THEN 1 ELSE 0 END AS new FROM ev WHERE ts IS NOT NULL),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM r GROUP BY session_id, run""")
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    return sessions.idle_sessions(base.events(spark, d))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 28800000001) > 28800000000 THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM r GROUP BY user_id, run""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.idle_sessions(load(spark, d, "events"), 28_800, 86_400 * 7, "user_id")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


def kept_messages(ttl_seconds: int) -> str:
    """SQL that follows each message from copy to copy: the next kept is the first at least ttl after the last."""
    return f"""WITH RECURSIVE {EVENT}, k AS (SELECT event_id, epoch_us(ts) AS t, sha1(concat_ws('-', coalesce(session_id, ''), coalesce(role, ''), coalesce(command, output, ''))) AS key FROM ev),
kept(key, t) AS (SELECT key, min(t) FROM k WHERE t IS NOT NULL GROUP BY key UNION ALL SELECT p.key, min(k.t) FROM kept p JOIN k ON k.key = p.key AND k.t >= p.t + {ttl_seconds * 1_000_000} GROUP BY p.key)
SELECT min(event_id) AS event_id, key AS message_key FROM k JOIN kept USING (key, t) GROUP BY key, t UNION ALL SELECT event_id, key FROM k WHERE t IS NULL"""


@query(kept_messages(3600))
def message_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sessions.distinct_messages(base.events(spark, d)).select("event_id", "message_key")


@query(kept_messages(30 * 86_400))
def message_dedup_monthly(spark: SparkSession, d: str) -> DataFrame:
    """The same with a memory of thirty days, in which copies come in chains."""
    return sessions.distinct_messages(base.events(spark, d), 30 * 86_400).select("event_id", "message_key")


@query(f"""WITH {EVENT}, h AS (SELECT session_id, ts, event_id, nullif(trim(metadata['project_name']), '') AS a, nullif(trim(metadata['project_id']), '') AS b, nullif(regexp_extract(metadata['cwd'], '([^/]+)/*$', 1), '') AS c FROM ev),
s AS (SELECT session_id, ts, event_id, coalesce(a, b, c) AS project_hint, CASE WHEN a IS NOT NULL THEN 0.95 WHEN b IS NOT NULL THEN 0.9 ELSE 0.6 END AS confidence FROM h WHERE coalesce(a, b, c) IS NOT NULL)
SELECT session_id, project_hint, confidence::DOUBLE AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, ts NULLS FIRST, event_id) = 1""")
def hint_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return sessions.hints(base.events(spark, d))


@query(f"""WITH {EVENT} SELECT session_id, count(command) AS n_commands, count(output) AS n_outputs, count(*) FILTER (exit_code <> 0) AS failures, min(ts) AS started_at, max(ts) AS ended_at,
(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM ev GROUP BY 1""")
def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    return sessions.summaries(base.events(spark, d))


@query(f"""WITH {EVENT} SELECT session_id, count(*) AS n_events, count(*) FILTER (epoch_us(received_at) - epoch_us(ts) > 3600000000) AS n_late, max((epoch_us(received_at) - epoch_us(ts)) / 1e6) AS worst_delay FROM ev GROUP BY 1""")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    return sessions.late(base.events(spark, d))


@query(f"WITH {EVENT} SELECT CASE role WHEN 'user' THEN 'command' WHEN 'assistant' THEN 'output' ELSE 'other' END AS spoken, count(*) AS n FROM ev GROUP BY 1")
def role_routing(spark: SparkSession, d: str) -> DataFrame:
    return sessions.routed(base.events(spark, d)).groupBy("spoken").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENT} SELECT session_id, event_id, md5(concat_ws(' ', strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), CASE WHEN command IS NOT NULL THEN '**User:**' ELSE '**Assistant:**' END,
CASE WHEN length(coalesce(command, output, '')) > 1000 THEN substring(coalesce(command, output, ''), 1, 1000) || '...' ELSE coalesce(command, output, '') END)) AS line_md5 FROM ev""")
def session_log(spark: SparkSession, d: str) -> DataFrame:
    return sessions.log_lines(base.events(spark, d)).select("session_id", "event_id", F.md5("line").alias("line_md5"))


@query(f"""WITH {EVENT}, o AS (SELECT *, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts), 600000001) > 600000000 THEN 1 ELSE 0 END AS new FROM ev WHERE ts IS NOT NULL AND session_id IS NOT NULL),
r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o),
s AS (SELECT *, session_id || '@' || epoch_us(min(ts) OVER (PARTITION BY session_id, run)) AS sid FROM r),
l AS (SELECT sid, ts, event_id, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) - 1 AS n, concat_ws(' ', strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), CASE WHEN command IS NOT NULL THEN '**User:**' ELSE '**Assistant:**' END,
CASE WHEN length(coalesce(command, output, '')) > 1000 THEN substring(coalesce(command, output, ''), 1, 1000) || '...' ELSE coalesce(command, output, '') END) AS line FROM s),
p AS (SELECT sid, n // 1000 AS part, string_agg(line, chr(10) ORDER BY ts, event_id) AS log FROM l GROUP BY ALL),
e AS (SELECT sid, max(ts) AS ended_at FROM s GROUP BY 1),
m AS (SELECT 'Session ' || sid || CASE WHEN part > 0 THEN ', part ' || (part + 1)::BIGINT ELSE '' END AS u, log AS a, ended_at, sid FROM p JOIN e USING (sid))
SELECT 'session' AS source, ended_at AS created_at, ['session://' || sid] AS refs, length('**User:**' || chr(10) || u || chr(10) || chr(10) || '**Assistant:**' || chr(10) || a) AS n_chars,
md5('**User:**' || chr(10) || u || chr(10) || chr(10) || '**Assistant:**' || chr(10) || a) AS content_md5 FROM m WHERE trim(a) <> ''""")
def session_memories(spark: SparkSession, d: str) -> DataFrame:
    """Each idle-closed run of a session's events as a memory."""
    inside = sessions.idle_runs(base.events(spark, d)).withColumn("session_id", F.concat("session_id", F.lit("@"), F.unix_micros("run_started"))).where("session_id is not null")
    talk = ingest.session_conversations(sessions.log_lines(inside), sessions.summaries(inside))
    return ingest.remember(talk, base.as_of())[0].select("source", "created_at", "refs", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started_at, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    grouped = load(spark, d, "events").where("ts is not null").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").cast("timestamp_ntz").alias("started_at"), "event_type", "n", "mean_value")
