"""Where queries and the SQL they are checked against are registered."""

from __future__ import annotations

from .fixtures import with_fixtures

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame; sql gives the same rows and may name fixtures."""

    def register(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_fixtures(sql)
        return f

    return register
