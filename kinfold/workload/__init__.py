"""Queries over the star-schema tables: one for each operator, with SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import derived, matching, streams
from .matching import flagship
from .schema import catalog


def queries_and_sql() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Name to (function of a session and a directory of tables, SQL)."""
    on_catalog = lambda f: lambda spark, sf_dir: f(catalog(spark, sf_dir))
    return {n: (on_catalog(f), sql) for n, (f, sql) in (matching.Q | derived.Q).items()} | streams.Q


__all__ = ["catalog", "flagship", "queries_and_sql"]
