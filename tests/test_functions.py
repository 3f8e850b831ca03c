import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollary.functions import attributes, scoring, text, vector


def value(spark, column, **row):
    kinds = {str: "string", int: "long", float: "double", datetime: "timestamp"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string') if not isinstance(v, list) else 'array<' + kinds[type(v[0])] + '>'}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def test_words_unicode_space(spark):
    assert value(spark, text.words("t"), t="Ab c　D  e") == ["ab", "c", "d", "e"]
    assert value(spark, text.words(F.lit(None).cast("string"))) == []


def test_tokens(spark):
    assert value(spark, text.count_tokens("t"), t="a b c d") == 5
    assert value(spark, text.count_tokens("t"), t="") == 0


def test_keywords(spark):
    assert value(spark, text.keywords("t"), t="The café-naïve deployment of the deployment plan") == ["deployment", "naïve", "café", "plan"]
    assert value(spark, text.keyword_signature("t"), t="why is the release blocked") == "blocked+release"


def test_language_and_class(spark):
    assert value(spark, text.language_simple("t"), t="これは") == "ja"
    assert value(spark, text.language_simple("t"), t="¿qué?") == "es"
    assert value(spark, text.schema_class("t"), t="an Error occurred") == "Incident"
    assert value(spark, text.schema_class("t"), t="decision: yes, error or not") == "Decision"
    assert value(spark, text.schema_class("t"), t="nothing") == "Process"


def test_conversation(spark):
    pair = value(spark, text.conversation("t"), t="**User:**\nhi\n\n**Assistant:**\nthere\nyou")
    assert (pair["user"], pair["assistant"]) == ("hi", "there\nyou")
    assert value(spark, text.conversation("t"), t="no talk") is None


def test_notes(spark):
    note = "---\ntitle: A\ntags: [x, 'y']\ntitle: B\n---\n[[One|alias]] and [[Two#part]] [[One]]"
    assert value(spark, text.front_matter("t"), t=note) == {"tags": "[x, 'y']", "title": "B"}
    assert value(spark, text.wikilinks("t"), t=note) == ["One", "Two"]
    assert value(spark, text.list_value("t"), t="[x, 'y']") == ["x", "y"]
    assert value(spark, text.front_matter("t"), t="plain") == {}


def test_summary_fields(spark):
    summary = "Topic: a\nDoc_Type: guide\n- text: one\n- text: two"
    assert value(spark, text.is_structured_summary("t"), t=summary) is True
    assert value(spark, text.summary_field("t", "doc_type"), t=summary) == "guide"
    assert value(spark, text.summary_decisions("t"), t=summary) == ["one", "two"]


def test_small_functions(spark):
    assert value(spark, text.looks_like_uuid("t"), t="123e4567-e89b-12d3-a456-426614174000") is True
    assert value(spark, text.outer_json("t"), t='noise {"a": 1} more') == '{"a": 1}'
    assert value(spark, text.outer_json("t"), t="{broken") is None
    assert value(spark, text.human_size("n"), n=2048) == "2.0 KB"
    assert value(spark, text.normalised_name("t"), t=" Winter-Orchard ") == "winterorchard"


def test_vectors(spark):
    assert value(spark, vector.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, vector.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert value(spark, vector.cosine("a", "b"), a=[1.0], b=[1.0, 1.0]) == 0
    assert value(spark, vector.normalise("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert value(spark, vector.usable("a"), a=[float("nan"), 1.0]) is False
    with pytest.raises(Exception, match="unlike sizes"):
        value(spark, vector.cosine_strict("a", "b"), a=[1.0], b=[1.0, 1.0])


def test_combined_score_worked_example(spark):
    features = {
        "strength": F.lit(1.0), "recency": F.lit(0.5), "refs": scoring.refs_reliability(F.lit(0)), "bm25": scoring.normalised_bm25(F.lit(1.0)),
        "vector": F.lit(0.4), "metadata": F.lit(0.0),
    }
    assert value(spark, scoring.combined(features)) == pytest.approx(0.584996, abs=1e-6)


def test_recency_edges(spark):
    now = F.lit("2025-01-02 00:00:00").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert value(spark, scoring.recency(none, F.lit("working"), now)) == 0.5
    assert value(spark, scoring.recency(F.lit("2025-06-01").cast("timestamp"), F.lit("x"), now)) == 1.0
    day = [value(spark, scoring.recency(F.lit("2025-01-01").cast("timestamp"), F.lit(k), now)) for k in ("working", "short_term", "long_term", "other")]
    assert day == pytest.approx([math.exp(-3), math.exp(-1), math.exp(-0.5), math.exp(-0.75)])


def test_salience_and_bands(spark):
    assert [round(value(spark, scoring.salience(F.lit(t))), 4) for t in (0, 128, 320, 256, 384, 1000)] == [0.5, 0.725, 1.0, 0.975, 0.975, round(0.95 - 0.15 * math.log1p(616 / 384), 4)]
    assert value(spark, scoring.semantic_cache_score(F.lit(0.75))) == pytest.approx(0.675)
    assert value(spark, scoring.semantic_cache_score(F.lit(0.5))) is None
    assert value(spark, scoring.relevance_band(F.lit(0.4))) == "medium"


def test_query_attributes(spark):
    a = value(spark, attributes.query_attributes("q"), q="INC-42 rollout failed")
    assert (a["topic"], a["doc_type"], a["severity"]) == ("deployment", "incident", "high")
    a = value(spark, attributes.query_attributes("q"), q="hello")
    assert (a["topic"], a["doc_type"], a["severity"]) == (None, None, None)
