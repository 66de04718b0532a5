"""All named queries of the library itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import audit, cleaning, corpus, evaluation, files, joins, jobs, ordered, repairs, statistics

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for module in (statistics, cleaning, joins, corpus, evaluation, ordered, audit, files, repairs, jobs):
        out |= module.QUERIES
    return out


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
