"""One place that pairs a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.views import E_SQL, M_SQL, R_SQL

VIEWS = {"m": M_SQL, "r": R_SQL, "e": E_SQL}


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Callable, sql: str | None = None, views: str = "") -> None:
        """sql is the part after `with`: further views may precede the final select, each name in `views` puts its view first."""
        self.queries[name] = query
        if sql is not None:
            body = sql.strip()
            head = ", ".join(VIEWS[v] for v in views)
            if head:
                body = f"with {head}" + (f", {body[5:]}" if body.startswith("with ") else f" {body}")
            self.oracle[name] = body
