"""Registered queries: a DataFrame builder and, beside it, the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a builder that takes the tables of a folder, under its own name or the one given."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name or build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name or build.__name__] = sql
        return build

    return register
