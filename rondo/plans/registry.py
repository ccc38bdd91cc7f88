"""Registry of named queries and the SQL each is checked against.

An oracle string may use ``#n[expr]#`` for a rounded double (n digits, -0.0 folded to 0.0).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ROUND = re.compile(r"#(\d?)\[(.*?)\]#", re.S)


def expand(sql: str) -> str:
    return _ROUND.sub(lambda m: f"(round(CAST({m.group(2)} AS DOUBLE), {m.group(1) or 6}) + 0.0)", sql)


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = (), recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is its check over ``views``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            needed = views.split() if isinstance(views, str) else views
            ORACLES[name] = expand(with_views(needed, sql, recursive))
        return fn

    return register


def load_all() -> None:
    from . import (  # noqa: F401
        aggregate_queries,
        clean_queries,
        drift_queries,
        join_queries,
        metric_queries,
        model_queries,
        monitor_queries,
        rating_queries,
        resample_queries,
        scoring_queries,
        source_queries,
        split_queries,
        stream_queries,
        window_queries,
    )
