"""Registered queries over the sample tables, each with its check in SQL.

A query takes a session and the folder of the tables. The check is one
statement over the same tables for another engine, or None where SQL cannot
express the query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselight.session import configure
from clauselight.sources.adapters import METADATA_SQL, RESULTS_SQL, USAGE_SQL

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    check: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, check: str | None = None):
    """Register a function as a query."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, run, check)
        return fn

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Averages rounded, since engines add doubles in different orders."""
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def usage_check(body: str) -> str:
    return f"WITH usage_analytics AS ({USAGE_SQL})\n{body}"


def storage_check(body: str) -> str:
    return (
        f"WITH document_metadata AS ({METADATA_SQL}),\n"
        f"processing_results AS ({RESULTS_SQL})\n{body}"
    )


def load() -> dict[str, Query]:
    """All queries; the modules register theirs when imported."""
    from clauselight.catalog import (  # noqa: F401
        events,
        extraction,
        lifecycle,
        responses,
        storage,
        streams,
        tables,
        text,
        usage,
    )

    return REGISTRY
