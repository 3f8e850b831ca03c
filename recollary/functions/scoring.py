"""Ranking features and life-cycle scores. Every score takes as_of, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"strength": 0.3, "recency": 0.2, "refs": 0.1, "bm25": 0.2, "vector": 0.2, "metadata": 1.0}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def seconds(later: Column, earlier: str | Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(col(earlier))) / 1e6


def recency(created_at: str | Column, memory_type: str | Column, as_of: Column, hours: float = 8.0) -> Column:
    """exp(-age / (hours x tier factor)); 0.5 where the time is unknown. A missing tier is working."""
    kind = F.coalesce(col(memory_type), F.lit("working"))
    factor = F.when(kind == "working", 1.0).when(kind == "short_term", 3.0).when(kind == "long_term", 6.0).otherwise(4.0)
    age = F.greatest(F.lit(0.0), seconds(as_of, created_at) / 3600)
    # (greatest and least skip nulls, so an unknown time must be told apart first)
    return F.when(col(created_at).isNull(), 0.5).otherwise(clamp(F.exp(-age / F.greatest(F.lit(hours) * factor, F.lit(1.0)))))


def refs_reliability(n_refs: str | Column) -> Column:
    n = F.greatest(F.coalesce(col(n_refs), F.lit(0)), F.lit(0))
    return F.when(n > 0, F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(11.0)))).otherwise(0.0)


def normalised_bm25(score: str | Column) -> Column:
    s = F.coalesce(col(score), F.lit(0.0))
    return F.when(s <= 0, 0.0).otherwise(1 / (1 + F.exp(-0.1 * s)))


def metadata_bonus(query: Column, source: Column, topic: Column, severity: Column, project: Column, wanted_project: Column) -> Column:
    """Small rules on source, topic, severity and project; wanted_project null: no project filter."""
    low, text = F.lower(F.coalesce(topic, F.lit(""))), F.lower(query)
    by_source = F.when(source == "session", -0.05).otherwise(0.0)
    by_topic = F.when(low == "", 0.0).when(F.contains(text, low), 0.05).otherwise(-0.01)
    by_severity = F.when((F.lower(severity) == "high") & text.rlike("incident|inc|bug|sev|pager"), 0.05).otherwise(0.0)
    by_project = F.when(wanted_project.isNull(), 0.0).when(F.coalesce(project == wanted_project, F.lit(False)), 0.03).otherwise(-0.05)
    return by_source + by_topic + F.coalesce(by_severity, F.lit(0.0)) + by_project


def attribute_bonus(topic: Column, doc_type: Column, severity: Column, wanted_topic: Column, wanted_type: Column, wanted_severity: Column) -> Column:
    """What query attributes add to the metadata bonus."""
    same = lambda a, b: F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
    by_topic = F.when(wanted_topic.isNull() | topic.isNull(), 0.0).when(same(topic, wanted_topic), 0.05).otherwise(-0.01)
    return by_topic + F.when(same(doc_type, wanted_type), 0.03).otherwise(0.0) + F.when(same(severity, wanted_severity), 0.02).otherwise(0.0)


def combined(features: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the six features, clamped to [0, 1]. Unknown weights are ignored."""
    use = WEIGHTS | {k: float(v) for k, v in (weights or {}).items() if k in WEIGHTS}
    total = F.lit(0.0)
    for name, weight in use.items():
        total = total + F.lit(weight) * features[name]
    return clamp(total)


def heuristic_relevance(vector: Column, bm25: Column, metadata: Column, recent: Column) -> Column:
    """What stands in for a cross-encoder's score."""
    return clamp(0.4 * vector + 0.3 * bm25 + 0.2 * metadata + 0.1 * recent)


def importance(accesses: Column, created_at: Column, n_refs: Column, as_of: Column) -> Column:
    """0.4 accesses + 0.3 freshness in whole days + 0.3 references; 0.5 without creation time."""
    days = F.floor(seconds(as_of, created_at) / 86400)
    a = F.log1p(F.greatest(F.coalesce(accesses, F.lit(0)), F.lit(0))) / F.log(F.lit(101.0))
    r = F.log1p(F.greatest(F.coalesce(n_refs, F.lit(0)), F.lit(0))) / F.log(F.lit(11.0))
    return F.when(created_at.isNull(), 0.5).otherwise(clamp(0.4 * a + 0.3 * F.exp(-F.greatest(F.lit(0), days) / 30.0) + 0.3 * r))


def boosted_strength(strength: str | Column, by: float = 0.1) -> Column:
    return F.least(F.lit(1.0), F.coalesce(col(strength), F.lit(0.5)) + by)


def salience(tokens: str | Column) -> Column:
    """Highest near 320 tokens, falling to both sides."""
    t = F.coalesce(col(tokens), F.lit(0)).cast("double")
    inside = F.greatest(F.lit(0.95), 1 - 0.05 * F.abs(t - 320) / 128)
    below = F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.5 + 0.45 * t / 256))
    above = F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.95 - 0.15 * F.log1p((t - 384) / 384)))
    return F.when((t >= 256) & (t <= 384), inside).when(t < 256, below).otherwise(above)


def semantic_cache_score(similarity: str | Column) -> Column:
    """What a cached neighbour's similarity is worth; null below the least tier."""
    s = col(similarity)
    return F.when(s >= 0.8, s * 0.95).when(s >= 0.7, s * 0.9).when(s >= 0.6, s * 0.85)


def relevance_band(score: str | Column) -> Column:
    return F.when(col(score) >= 0.7, "high").when(col(score) >= 0.4, "medium").otherwise("low")
