"""Registered queries of mobility analytics."""

from __future__ import annotations

from roamer.plans import basic, electric, features, mobility
from roamer.plans.registry import QUERIES, SQL, Query

MODULES = (basic, mobility, features, electric)


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
