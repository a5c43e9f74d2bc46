"""How a module of plans keeps its queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, sql, decorator): ``@query("SELECT ...")`` files a function of (spark, folder) under its name."""
    queries: dict[str, Callable] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return keep

    return queries, sqls, query
