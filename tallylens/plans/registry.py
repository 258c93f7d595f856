"""Where queries register themselves, with their SQL for other engines."""

from __future__ import annotations

from . import views as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in V.VIEWS_SQL.items())


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{WITH} {sql}"
        return f

    return add
