"""How a module of queries names them."""

from __future__ import annotations

from collections.abc import Callable


def register(queries: dict, oracle: dict) -> Callable:
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query
