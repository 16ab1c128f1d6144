"""Registry of named queries, each with its DuckDB twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staylens.functions.wire import normalize_record
from staylens.plans.oracle_tables import TABLES
from staylens.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query. Its result leaves in wire form: ISO date text, four-digit doubles, joined arrays."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: normalize_record(build(configure(spark), sf_dir))
        if oracle is not None:
            ORACLES[name] = TABLES + oracle.strip()
        return build

    return register
