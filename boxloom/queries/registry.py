"""Registry of runnable queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxloom.queries.fixture_sql import FIXTURE_SQL, FIXTURE_NEEDS
from boxloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixture_names(names: list[str]) -> list[str]:
    """Fixture names in dependency order, each once."""
    ordered: list[str] = []
    for name in names:
        for item in [*fixture_names(list(FIXTURE_NEEDS.get(name, ()))), name]:
            if item not in ordered:
                ordered.append(item)
    return ordered


def sql(fixtures: str, body: str, recursive: bool = False) -> str:
    """A DuckDB statement over named fixtures; ``body`` may open with ``, more AS (...)``."""
    parts = [f"{n} AS ({FIXTURE_SQL[n]})" for n in fixture_names(fixtures.split())]
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) if parts else ""
    return f"{head}\n{body.strip()}"


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
