"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Plan = Callable[[Tables], DataFrame]


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan over ``Tables``; ``oracle`` is SQL over the same tables."""

    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[key] = oracle
        return plan

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL over the tables; it is its own oracle where portable."""
    query(text if oracle is None else oracle, name)(lambda t: t.sql(text))
