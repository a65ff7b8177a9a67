"""Registry of named queries over the given tables, each with its DuckDB oracle.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its oracle is SQL that DuckDB
runs on the same parquet tables (registered as views of the same names);
column names agree so results can be compared. Queries without an oracle
(iterative or stateful operators) are checked by tests against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    bench: bool = False


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, bench: bool = False):
    def register(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = Query(name, fn, sql, bench)
        return fn
    return register


def all_queries() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from winnow.plans import (q_bpe, q_chat, q_classify, q_flows, q_jobs, q_lm, q_merge,  # noqa: F401
                              q_tokens, q_vectors)
    return dict(_QUERIES)
