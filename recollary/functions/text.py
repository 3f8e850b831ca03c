"""Text functions as Column expressions: tokens, keywords, languages, classes, summaries, notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of keywords.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "can", "must", "this", "that", "these", "those",
    "it", "its", "what", "which", "who", "when", "where", "why", "how",
    "の", "は", "が", "を", "に", "へ", "と", "で", "や", "か", "も", "から", "まで", "より", "など", "として", "について", "による",
    "こと", "もの", "ため", "よう", "これ", "それ", "あれ", "どれ",
]


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: str | Column) -> Column:
    """Lower-case tokens parted by any Unicode white space. Null has none."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def count_tokens(text: str | Column) -> Column:
    """Words / 0.75, rounded down. Null counts 0."""
    return F.floor(F.coalesce(F.regexp_count(col(text), F.lit(r"(?U)\S+")), F.lit(0)) / 0.75).cast("int")


def keywords(text: str | Column, n: int = 5, least: int = 3) -> Column:
    """The n longest words (ties in order of characters), without stop words and short ones."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(col(text), F.lit("")))), r"[^\p{L}\p{N}_\s\-]", " ")
    found = F.array_distinct(F.filter(F.split(bare, r"[\s\-_]+"), lambda w: (F.length(w) >= least) & ~w.isin(STOP_WORDS)))
    ranked = F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda s: s["w"]), 1, n)


def keyword_signature(text: str | Column, n: int = 3) -> Column:
    """The n keywords in order of characters, joined by '+': a key that similar queries share."""
    return F.array_join(F.array_sort(keywords(text, n)), "+")


def language_simple(text: str | Column) -> Column:
    """ja by kana or Han, es by its accents and marks, else en."""
    text = F.coalesce(col(text), F.lit(""))
    return F.when(text.rlike("[぀-ヿ一-鿿]"), "ja").when(text.rlike("[áéíóúñ¿¡]"), "es").otherwise("en")


def schema_class(text: str | Column) -> Column:
    """Incident, Snippet, Decision or Process: by the label in the first word, else by families of words.

    A deterministic stand-in for a model's answer, applied to the content itself."""
    low = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    first = F.regexp_extract(low, r"^(\S*)", 1)
    named = F.when(first.contains("incident"), "Incident").when(first.contains("snippet"), "Snippet")
    named = named.when(first.contains("decision"), "Decision").when(first.contains("process"), "Process")
    by = named.when(low.rlike("bug|error|fail|exception|crash"), "Incident").when(low.rlike("code|example|snippet|implementation"), "Snippet")
    return by.when(low.rlike("choose|decision|trade|compare"), "Decision").otherwise("Process")


def conversation(text: str | Column) -> Column:
    """user and assistant part of a Markdown conversation; null if it is none."""
    pattern = r"(?s)^\s*(?:\*\*User:\*\*|User:)\s*(.*?)\s*\n+(?:\*\*Assistant:\*\*|Assistant:)\s*(.*)$"
    user, assistant = F.regexp_extract(col(text), pattern, 1), F.regexp_extract(col(text), pattern, 2)
    return F.when((user != "") & (assistant != ""), F.struct(user.alias("user"), assistant.alias("assistant")))


def excerpt(text: str | Column, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "), 1, size)


def fallback_summary(user: str | Column, assistant: str | Column, topic: str | Column, doc_type: str | Column) -> Column:
    """The structured summary that stands in for a model's."""
    known = lambda c: F.coalesce(F.nullif(F.trim(col(c)), F.lit("")), F.lit("UNKNOWN"))
    action = lambda c: F.coalesce(F.nullif(F.trim(excerpt(c)), F.lit("")), F.lit("N/A"))
    lines = [("Topic: ", known(topic)), ("DocType: ", known(doc_type)), ("Project: ", F.lit("UNKNOWN")), ("KeyActions: ", F.concat(action(user), F.lit(" -> "), action(assistant)))]
    return F.concat_ws("\n", *[F.concat(F.lit(a), b) for a, b in lines])


def first_heading(text: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?m)^#{1,3}[ \t]+(.+)$", 1)


def enriched_summary(summary: str | Column, content: str | Column) -> Column:
    """Summary, keywords and first heading of the content, joined by ' | '."""
    found = keywords(content)
    return F.concat_ws(
        " | ",
        F.nullif(F.trim(F.coalesce(col(summary), F.lit(""))), F.lit("")),
        F.when(F.size(found) > 0, F.concat(F.lit("Keywords: "), F.array_join(found, ", "))),
        F.when(first_heading(content) != "", F.concat(F.lit("Topic: "), F.trim(first_heading(content)))),
    )


def is_structured_summary(text: str | Column) -> Column:
    return F.coalesce(col(text).rlike(r"(?mi)^(topic|doc_type|project):\s*.+$"), F.lit(False))


def summary_field(text: str | Column, field: str) -> Column:
    """Value of a 'field: value' line of a structured summary; null if absent."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(col(text), F.lit("")), rf"(?mi)^{field}:[ \t]*(.+)$", 1)), F.lit(""))


def summary_decisions(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?m)^\s*-\s*text:\s*(.+)$"), F.lit(1)), lambda x: F.trim(x))


def wikilinks(text: str | Column) -> Column:
    """Targets of [[links]], without alias and anchor, sorted."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    bare = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"[|#].*$", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: x != "")))


def front_matter(text: str | Column) -> Column:
    """Map of the 'key: value' lines between leading --- marks; nested values are not parsed."""
    block = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?s)\A---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    # a repeated key keeps its last value
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def list_value(value: str | Column) -> Column:
    """The items of a '[a, b]' value; a plain value is a list of one."""
    inner = F.regexp_extract(col(value), r"^\[(.*)\]$", 1)
    items = F.when(col(value).rlike(r"^\[.*\]$"), F.split(inner, ",")).otherwise(F.array(col(value)))
    return F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, "[\"']", ""))), lambda x: x != "")


def message_key(session: str | Column, role: str | Column, text: str | Column) -> Column:
    return F.sha1(F.concat_ws("-", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in (session, role, text)]))


def looks_like_uuid(text: str | Column) -> Column:
    return F.coalesce(col(text).rlike("(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), F.lit(False))


def outer_json(text: str | Column) -> Column:
    """The text from its first { to its last }, if that parses as JSON; else null."""
    inner = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def human_size(size: str | Column) -> Column:
    n = col(size).cast("double")
    unit = F.when(n < 1024, F.format_string("%.1f B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
    return unit.when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.1f GB", n / 1024**3))


def normalised_name(name: str | Column) -> Column:
    """Lower case without white space, hyphens and underscores: how project names are compared."""
    return F.regexp_replace(F.lower(F.trim(col(name))), r"[\s_\-]+", "")
