"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under ``name``, with DuckDB SQL for the same rows if there is any."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
