"""Named queries: how Spark builds the result and, where SQL can say it, the oracle."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from creditloom.session import configure
from creditloom.sources.views import view_sql

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None
    covers: str
    trains: bool = False


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, trains: bool = False):
    """Register a function as a query; ``covers`` lists the inventory rows it shows.

    ``trains`` marks a query that fits models at their full settings, which takes minutes.
    """

    def add(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[build.__name__] = Query(run, sql, covers, trains)
        return build

    return add


def with_views(views: Iterable[str], body: str, ctes: Iterable[str] = ()) -> str:
    """Oracle text: the views as CTEs, further CTEs, then the body."""
    parts = [f"{v} as ({view_sql(v)})" for v in views] + list(ctes)
    return f"with {', '.join(parts)} {body}"


def r6(expr: str, name: str | None = None) -> str:
    """A rounded double column of the oracle."""
    return f"floor(({expr})*1e6+5e-1)/1e6 as {name or expr}"


def columns_sql(exact: Iterable[str], doubles: Iterable[str]) -> str:
    return ", ".join([*exact, *[r6(c) for c in doubles]])
