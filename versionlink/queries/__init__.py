"""All named queries with their SQL counterparts."""

from __future__ import annotations


def all_queries() -> dict:
    from versionlink.queries import graph, link, text  # noqa: F401
    from versionlink.queries.registry import QUERIES

    return dict(QUERIES)


def all_sql() -> dict:
    all_queries()
    from versionlink.queries.registry import SQL

    return dict(SQL)
