"""Every query of the engine's own operators, by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir), and its SQL twin if there is one."""

    def add(fn):
        key = name or fn.__name__
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn

    return add


from . import content, facts, graphs, html, logs, metrics, pages, site  # noqa: E402,F401  registers on import
