"""Decorator that registers queries with their SQL in a module's own tables."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


#: The events table on an epoch-millisecond axis, as a common table expression.
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS t_ms FROM events)"
