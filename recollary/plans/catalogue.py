"""All registered queries of the core."""

from __future__ import annotations

from recollary.plans import activity, lifecycle, measures, retrieval, texts  # noqa: F401 (they register)
from recollary.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
