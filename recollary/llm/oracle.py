"""DuckDB equivalents of the training-data queries that SQL can express."""

from __future__ import annotations

from recollary.llm.fusion import STAND_INS

WORDS = ", ".join(f"'{w}'" for w in STAND_INS)

#: White space of any kind, as one character class.
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

#: One row per memory in a cluster of two or more, with the order of members and the usable fields.
MEMBERS = f"""
rows AS (
  SELECT lower(trim(cluster_id)) AS cluster_id, memory_id, created_at, updated_at, ingested_at, importance, source,
         summary, project_id, topic, severity, doc_type
  FROM memories
  WHERE cluster_id IS NOT NULL AND trim(cluster_id) <> '' AND memory_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(cluster_id)), memory_id ORDER BY ingested_at) = 1
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM rows
), members AS (
  SELECT *, updated_at IS NOT NULL AND NOT coalesce(updated_at < created_at, FALSE) AND NOT coalesce(updated_at > ingested_at, FALSE) AS timely,
         coalesce(importance BETWEEN 0 AND 1, FALSE) AS weighed
  FROM sized WHERE n > 1
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY
      timely DESC, CASE WHEN timely THEN updated_at END DESC NULLS LAST,
      weighed DESC, CASE WHEN weighed THEN importance END DESC NULLS LAST, memory_id) AS place
  FROM members
), fields AS (
  UNPIVOT placed ON summary, project_id, topic, severity, doc_type INTO NAME field_name VALUE value
), filled AS (
  SELECT * FROM fields WHERE trim(value) <> '' AND lower(trim(value)) NOT IN ({WORDS})
)"""


def fused(rounds: int = 3, accuracy: float = 0.8, copying: float = 0.8, n_false: int = 20, suspicion: float = 0.1) -> str:
    """The estimation of fusion.fuse without a prior, unrolled: tables known_k and learned_k of each round k."""
    bare = lambda c: f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    sql = f"""
WITH {MEMBERS}, claims AS (
  SELECT cluster_id, field_name, {bare("value")} AS value, coalesce({bare("source")}, '') AS source, min(place) AS place,
         min(coalesce(created_at, ingested_at)) AS stated_at
  FROM filled GROUP BY ALL
), origins AS (
  SELECT cluster_id, field_name, value, first(source ORDER BY stated_at NULLS FIRST, source) AS origin FROM claims GROUP BY ALL
), openers AS (
  SELECT cluster_id, field_name, first(source ORDER BY stated_at NULLS FIRST, source, value) AS opener,
         first(value ORDER BY stated_at NULLS FIRST, source, value) AS opening
  FROM claims GROUP BY ALL
), base AS (
  SELECT * FROM claims JOIN origins USING (cluster_id, field_name, value) JOIN openers USING (cluster_id, field_name)
), scored_1 AS (
  SELECT *, {accuracy} AS accuracy, 0.0 AS dependent FROM base
)"""
    for k in range(1, rounds + 1):
        sql += f""", votes_{k} AS (
  SELECT cluster_id, field_name, value, min(place) AS place,
         sum(ln({n_false} * accuracy / (1 - accuracy)) * CASE WHEN source = origin THEN 1 ELSE 1 - {copying} * dependent END) AS weight
  FROM scored_{k} GROUP BY ALL
), topped_{k} AS (
  SELECT *, max(weight) OVER (PARTITION BY cluster_id, field_name) AS top FROM votes_{k}
), known_{k} AS (
  SELECT *, exp(weight - top) / (sum(exp(weight - top)) OVER (PARTITION BY cluster_id, field_name) + {n_false} * exp(-top)) AS probability FROM topped_{k}
), judged_{k} AS (
  SELECT base.*, probability FROM base JOIN known_{k} USING (cluster_id, field_name, value)
), sources_{k} AS (
  SELECT source, greatest(0.05, least(0.95, avg(probability))) AS accuracy FROM judged_{k} GROUP BY source
), met_{k} AS (
  SELECT source, origin, probability AS yes, 1 - probability AS no, 0 AS other FROM judged_{k} WHERE source <> origin
  UNION ALL
  SELECT source, opener AS origin, 0 AS yes, 0 AS no, 1 AS other FROM judged_{k}
  WHERE source <> opener AND origin <> opener AND value <> opening
), pairs_{k} AS (
  SELECT m.source, m.origin, 1 / (1 + exp(-(ln({suspicion} / (1 - {suspicion})) + sum(yes) * ln(1 - {copying} + {copying} / any_value(accuracy))
         + sum(no) * ln(1 - {copying} + {copying} * {n_false} / (1 - any_value(accuracy))) + sum(other) * ln(1 - {copying})))) AS dependent
  FROM met_{k} m JOIN sources_{k} USING (source) GROUP BY ALL
), scored_{k + 1} AS (
  SELECT base.*, s.accuracy, coalesce(p.dependent, 0) AS dependent
  FROM base JOIN sources_{k} s USING (source) LEFT JOIN pairs_{k} p ON p.source = base.source AND p.origin = base.origin
)"""
    return sql


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
WITH {MEMBERS}, counted AS (
  SELECT p.cluster_id, p.memory_id, p.place, count(f.field_name) AS n_filled
  FROM placed p LEFT JOIN filled f USING (cluster_id, memory_id) GROUP BY ALL
)
SELECT cluster_id, field_name, memory_id FROM filled
QUALIFY row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY place) = 1
UNION ALL
SELECT cluster_id, 'record' AS field_name, memory_id FROM counted
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n_filled DESC, place) = 1""",
        "p1_fused": f"""{fused()}
SELECT cluster_id, field_name, value, memory_id, probability FROM (
  SELECT k.cluster_id, k.field_name, k.value, p.memory_id, round(k.probability, 6) AS probability
  FROM known_3 k JOIN placed p ON p.cluster_id = k.cluster_id AND p.place = k.place
  QUALIFY row_number() OVER (PARTITION BY k.cluster_id, k.field_name ORDER BY round(k.weight, 9) DESC, k.place) = 1
)
UNION ALL
SELECT cluster_id, 'record' AS field_name, NULL AS value, memory_id, NULL AS probability FROM (
  SELECT p.cluster_id, p.memory_id, p.place, count(f.field_name) AS n_filled
  FROM placed p LEFT JOIN filled f USING (cluster_id, memory_id) GROUP BY ALL
) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n_filled DESC, place) = 1""",
        "p1_sources": f"""{fused()}
SELECT s.source, round(s.accuracy, 6) AS accuracy, p.origin, round(p.dependent, 6) AS dependent
FROM sources_3 s LEFT JOIN pairs_3 p ON p.source = s.source""",
        "p3_found": """
WITH items AS (
  SELECT 'memory' AS item_kind, memory_id AS item_id, content FROM memories
  UNION ALL SELECT 'chunk' AS item_kind, chunk_id AS item_id, content FROM chunks
)
SELECT DISTINCT item_kind, item_id FROM items
WHERE length(content) > 3500
   OR floor(len(list_filter(regexp_split_to_array(content, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')) / 0.75) > 512""",
        "p7_found": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM dw, unnest(range(1, len(w) - 11)) t(i)),
ig AS (SELECT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM iw, unnest(range(1, len(w) - 11)) t(i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p6_kept": "SELECT doc_id, length(coalesce(text, '')) AS length, strlen(coalesce(text, '')) AS tokens, TRUE AS whole FROM documents",
        "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
    }
