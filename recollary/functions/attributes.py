"""Query attributes by dictionary: topic, document type and severity of a search query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollary.functions.text import keywords

# The first phrase, in this order, that the lower-case query contains decides.
TOPICS = {
    "timeline": "timeline", "release": "release", "rerank": "rerank", "chunker": "chunker", "dashboard": "dashboard", "governance": "governance",
    "policy": "policy", "obsidian": "obsidian", "retention": "policy", "retention policy": "policy", "change feed": "ingestion",
    "consolidation": "consolidation", "doctor report": "health", "doctor": "health", "再発防止": "chunker", "再デプロイ": "chunker",
    "deployment": "deployment", "deploy": "deployment", "rollout": "deployment", "canary": "deployment", "blue-green": "deployment",
    "blue green": "deployment", "release notes": "release", "hotfix": "release", "patch": "release", "version": "release",
    "alert": "monitoring", "monitoring": "monitoring", "sla": "monitoring", "downtime": "incident", "outage": "incident",
    "degradation": "incident", "incident response": "incident", "root cause": "incident", "rca": "incident",
    "audit": "audit", "compliance": "compliance", "security": "security", "vulnerability": "security", "pen test": "security", "penetration": "security",
    "refactor": "development", "tech debt": "development", "technical debt": "development", "prototype": "development", "poc": "development", "proof of concept": "development",
    "backup": "operations", "disaster recovery": "operations", "failover": "operations", "scaling": "operations", "capacity": "operations", "performance": "operations", "optimization": "optimization",
    "data migration": "data", "etl": "data", "pipeline": "data", "streaming": "ingestion", "migration": "development",
    "タイムライン": "timeline", "リリース": "release", "デプロイ": "deployment", "障害": "incident", "監査": "audit", "開発": "development",
    "despliegue": "deployment", "lanzamiento": "release", "incidente": "incident", "incidentes": "incident", "auditoría": "audit",
}
DOC_TYPES = {
    "checklist": "checklist", "runbook": "checklist", "experiment": "experiment", "postmortem": "postmortem", "template": "template", "guide": "guide",
    "report": "report", "doctor report": "report", "change log": "runbook", "retention policy": "policy",
    "deployment guide": "guide", "rollout plan": "checklist", "release notes": "changelog", "changelog": "changelog",
    "incident report": "incident", "rca": "postmortem", "root cause analysis": "postmortem", "incident log": "report",
    "audit report": "report", "compliance checklist": "checklist", "security policy": "policy",
    "design doc": "design", "architecture": "design", "rfc": "design", "proposal": "design",
    "error": "incident", "bug": "incident", "fix": "incident", "typeerror": "incident", "exception": "incident", "crash": "incident",
    "triage": "checklist", "vault": "guide", "edits": "changelog", "feed": "guide",
    "summary": "report", "overview": "report", "status": "report", "resumen": "report", "piloto": "guide",
    "手順書": "guide", "チェックリスト": "checklist", "報告書": "report", "テンプレート": "template",
    "lista de verificación": "checklist", "guía": "guide", "informe": "report", "incident": "incident",
}
SEVERITIES = {"sev1": "high", "sev2": "medium", "sev3": "low", "critical": "high", "high priority": "high", "major": "medium"}
INCIDENT = r"inc[-_ ]?\d+"


def looked_up(text: Column, table: dict[str, str]) -> Column:
    """Value of the table's first phrase that the text contains; null if none is in it."""
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()]), lambda e: F.contains(text, e["k"]))
    return F.get(found, F.lit(0))["v"]


def query_attributes(query: str | Column) -> Column:
    """Struct of topic, doc_type, severity, keywords. An incident number fills what is still empty."""
    text = F.lower(F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit("")))
    number = text.rlike(INCIDENT)
    return F.struct(
        F.coalesce(looked_up(text, TOPICS), F.when(number, "incident")).alias("topic"),
        F.coalesce(looked_up(text, DOC_TYPES), F.when(number, "incident")).alias("doc_type"),
        F.coalesce(looked_up(text, SEVERITIES), F.when(number, "high")).alias("severity"),
        keywords(text, 10).alias("keywords"),
    )
