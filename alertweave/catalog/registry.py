"""Registration of named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertweave.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def with_(*parts: str) -> str:
    """`WITH` over all parts but the last, which is the body."""
    return "WITH " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()


_STORED: dict[tuple, DataFrame] = {}


def stored(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result made once per session and input folder, then read by every analysis of it, as stored records are."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = cut_lineage(make())
    return _STORED[key]


def forget() -> None:
    """Drop the stored results, so that the next query makes its own."""
    _STORED.clear()
