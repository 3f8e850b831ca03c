"""From conversations to memories and chunks. Model calls are replaced by deterministic rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollary.functions import text as T
from recollary.functions.scoring import salience

HEADING = re.compile(r"^#{1,6}\s+\S")


def n_tokens(text: str) -> int:
    return int(len(text.split()) / 0.75)


def sections(text: str) -> list[str]:
    """Parts that begin with a heading (and what comes before the first); fences are never cut."""
    parts, fence = [[]], ""
    for line in text.split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if mark:
            fence = "" if fence and mark[1].startswith(fence) else fence or mark[1][:3]
        elif not fence and HEADING.match(line) and parts[-1]:
            parts.append([])
        parts[-1].append(line)
    return ["\n".join(p) for p in parts]


def paragraphs(text: str) -> list[str]:
    """Blocks between blank lines; a fence with its blank lines is one block."""
    blocks, fence = [[]], ""
    for line in text.split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if mark:
            fence = "" if fence and mark[1].startswith(fence) else fence or mark[1][:3]
        if not line.strip() and not fence:
            if blocks[-1]:
                blocks.append([])
            continue
        blocks[-1].append(line)
    return ["\n".join(b) for b in blocks if b]


def packed(parts: list[str], joint: str, most: int) -> list[str]:
    """Neighbouring parts joined as long as they stay within most tokens."""
    made: list[str] = []
    for part in parts:
        if made and n_tokens(made[-1] + joint + part) <= most:
            made[-1] += joint + part
        else:
            made.append(part)
    return made


def chunk(text: str, most: int = 512, least: int = 50) -> list[tuple[int, str]]:
    """(index, content) of the chunks of a Markdown text: by headings, then paragraphs, then sentences.

    A sentence or fence beyond the limit stays whole. A chunk below least tokens takes up the next if both
    fit. Blank chunks are left out, but keep their index."""
    if n_tokens(text) <= most:
        return [(0, text)] if text.strip() else []
    made: list[str] = []
    for section in sections(text):
        if n_tokens(section) <= most:
            made.append(section)
            continue
        blocks: list[str] = []
        for block in paragraphs(section):
            fenced = block.lstrip().startswith(("```", "~~~"))
            if fenced or n_tokens(block) <= most:
                blocks.append(block)
            else:
                blocks += packed(re.split(r"(?<=[.!?])\s+", block), " ", most)
        made += packed(blocks, "\n\n", most)
    merged: list[str] = []
    for part in made:
        if merged and n_tokens(merged[-1]) < least and n_tokens(merged[-1] + "\n\n" + part) <= most:
            merged[-1] += "\n\n" + part
        else:
            merged.append(part)
    return [(i, part.strip()) for i, part in enumerate(merged) if part.strip()]


def chunks(memories: DataFrame, most: int = 512, least: int = 50) -> DataFrame:
    """chunk_id, memory_id, chunk_index, content, tokens, salience_weight of every memory's content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(m, i, part) for m, body in zip(batch["memory_id"], batch["content"]) if body for i, part in chunk(body, most, least)]
            yield pd.DataFrame(rows, columns=["memory_id", "chunk_index", "content"])

    cut = memories.select("memory_id", "content").mapInPandas(run, "memory_id string, chunk_index int, content string")
    counted = cut.withColumn("tokens", T.count_tokens("content"))
    return counted.select(F.concat("memory_id", F.lit("-chunk-"), "chunk_index").alias("chunk_id"), "memory_id", "chunk_index", "content", "tokens", salience("tokens").alias("salience_weight"))


def memory_id(*parts: str | Column) -> Column:
    """A repeatable id: the same conversation always gets the same."""
    return F.concat(F.lit("mem-"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(T.col(p).cast("string"), F.lit("")) for p in parts])), 1, 12))


def remember(conversations: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Memories (tier working, strength 1.0, importance 0.5) and rejected rows.

    conversations: user, assistant, source, created_at, project_id, refs, topic, doc_type. A row without user or
    assistant text is rejected, not an error; a missing time becomes as_of."""
    bad = (F.coalesce(F.trim("user"), F.lit("")) == "") | (F.coalesce(F.trim("assistant"), F.lit("")) == "")
    good = conversations.where(~bad)
    at = F.coalesce("created_at", as_of)
    content = F.concat(F.lit("**User:**\n"), "user", F.lit("\n\n**Assistant:**\n"), "assistant")
    own = memory_id("source", "created_at", "user", "assistant")
    rows = good.select(
        own.alias("memory_id"), F.concat(own, F.lit("-metadata")).alias("entry_id"), T.schema_class(content).alias("schema_type"), F.lit("working").alias("memory_type"),
        content.alias("content"), T.fallback_summary("user", "assistant", "topic", "doc_type").alias("summary"), F.lit(1.0).alias("strength"), F.lit(0.5).alias("importance"),
        "project_id", "source", "topic", "doc_type", T.language_simple(content).alias("language"), "refs", at.alias("created_at"), at.alias("updated_at"),
    )
    return rows.dropDuplicates(["memory_id"]), conversations.where(bad)


def long_pieces(text: str, size: int = 3500, overlap: int = 200) -> list[str]:
    """Pieces of at most size characters for summarising, cut at the last line end of the final tenth."""
    made, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            line = text.rfind("\n", at + int(size * 0.9), end)
            end = line + 1 if line > at else end
        made.append(text[at:end])
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return made


def session_conversations(lines: DataFrame, sessions: DataFrame, most: int = 1000, bucket_seconds: int = 60) -> DataFrame:
    """Closed sessions as conversations, with refs session://id and their counts.

    lines: sessions.log_lines(). A log of more than most lines becomes parts of that length, a row each with the
    session's ref, so that no session's text is one value. Lines are numbered within buckets of time first,
    and only the buckets' sizes are summed over the session."""
    bucket = F.floor(F.unix_micros("ts") / (bucket_seconds * 1_000_000))
    placed = lines.withColumn("b", bucket).withColumn("n", F.row_number().over(Window.partitionBy("session_id", "b").orderBy("ts", "event_id")))
    sizes = placed.groupBy("session_id", "b").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("session_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("session_id").alias("_s"), F.col("b").alias("_b"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    numbered = placed.join(before, F.col("session_id").eqNullSafe(F.col("_s")) & F.col("b").eqNullSafe(F.col("_b")))
    parts = numbered.withColumn("part", F.floor((F.col("before") + F.col("n") - 1) / most))
    joined = parts.groupBy("session_id", "part").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))).alias("l"))
    log = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    named = F.when(F.col("part") > 0, F.concat(F.lit(", part "), F.col("part") + 1)).otherwise("")
    return joined.join(sessions, "session_id").select(
        F.concat(F.lit("Session "), "session_id", named).alias("user"), log.alias("assistant"), F.lit("session").alias("source"), F.col("ended_at").alias("created_at"),
        F.lit(None).cast("string").alias("project_id"), F.array(F.concat(F.lit("session://"), "session_id")).alias("refs"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("doc_type"), "n_commands", "seconds",
    )


def summarise_long(texts: DataFrame, key: str, text: str, summarise, size: int = 3500, overlap: int = 200) -> DataFrame:
    """key, summary: texts within size in one go; longer ones by pieces, whose summaries are summarised.

    summarise: a function of a Column. The piece summaries of one text are joined in order; they are bounded by
    that text's length."""
    rows = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(k, i, p) for k, body in zip(batch["key"], batch["body"]) for i, p in enumerate(long_pieces(body, size, overlap))]
            yield pd.DataFrame(made, columns=["key", "i", "piece"])

    kind = rows.schema["key"].dataType.simpleString()
    short = rows.where(F.length("body") <= size).select("key", summarise(F.col("body")).alias("summary"))
    pieces = rows.where(F.length("body") > size).mapInPandas(cut, f"key {kind}, i int, piece string").select("key", "i", summarise(F.col("piece")).alias("s"))
    joined = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("l"))
    long = joined.select("key", summarise(F.array_join(F.transform("l", lambda x: x["s"]), "\n\n---\n\n")).alias("summary"))
    return short.unionByName(long).withColumnRenamed("key", key)


def refreshed(memories: DataFrame, embed, dry_run: bool = False) -> DataFrame:
    """Memories with enriched_summary and embedding made anew; dry_run only shows the summaries."""
    enriched = memories.withColumn("enriched_summary", T.enriched_summary("summary", "content"))
    return enriched.select("memory_id", "enriched_summary") if dry_run else enriched.withColumn("embedding", embed(F.col("enriched_summary")))
