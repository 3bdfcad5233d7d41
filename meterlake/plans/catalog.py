"""All registered queries of the library's own operators."""

from __future__ import annotations

from meterlake.plans import base, profile_queries, series_queries, table_queries, temporal_queries  # noqa: F401
from meterlake.plans.series_queries import flagship  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
