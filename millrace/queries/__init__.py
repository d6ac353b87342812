"""Queries of the driver contract over the catalogue operators, by subject."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, each with its SQL counterpart if there is one."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
