"""All queries over the test tables by name."""

from __future__ import annotations

from . import chunks, corpus, eligibility, memories, metrics, relational, retrieval, scalars, sets, streams, traces  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    """Queries by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query."""
    return dict(SQL)
