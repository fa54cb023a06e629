"""The catalogue of queries: importing the plan modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, functions, joins, relational, reports, stats, streams, tpch, userfns, windows  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-way join of the catalogue."""
    return QUERIES["tpch_q5"](spark, sf_dir)
