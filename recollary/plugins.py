"""What a deployment with models replaces: each plug-in is a function of Columns, or a pandas UDF of that form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollary.functions import scoring, text


def toy_embedding(content: Column, size: int = 64) -> Column:
    """A repeatable stand-in for an embedding: equal texts get equal vectors, nothing more."""
    seed = F.pmod(F.xxhash64(F.coalesce(content, F.lit(""))), F.lit(1000))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: ((seed + i) / 1000).cast("float"))


@dataclass(frozen=True)
class Models:
    """embed(content), classify(content), summarise(user, assistant, topic, doc_type), relevance(vector, bm25,
    metadata, recency): the defaults are deterministic rules."""

    embed: Callable[[Column], Column] = toy_embedding
    classify: Callable[[Column], Column] = text.schema_class
    summarise: Callable[[Column, Column, Column, Column], Column] = text.fallback_summary
    relevance: Callable[[Column, Column, Column, Column], Column] = scoring.heuristic_relevance


def route(language: Column, supported: tuple[str, ...] = ("en", "es", "ja"), otherwise: str = "cloud") -> Column:
    """Where a text's summary is made: local if its language is supported."""
    return F.when(F.coalesce(language.isin(*supported), F.lit(False)), "local").otherwise(otherwise)
