"""Lookup of functions by name, with the further spellings that users know.

Spark's own names resolve to ``pyspark.sql.functions`` or, where the Python API
lacks one, to the SQL function.  ALIASES adds spellings of other dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ALIASES: dict[str, Callable[..., Column]] = {
    "iff": lambda test, then, other: F.when(test, then).otherwise(other),
    "if": lambda test, then, other: F.when(test, then).otherwise(other),
    "isinf": lambda c: F.abs(c) == F.lit(float("inf")),
    "array_reverse": F.reverse,
    "array_concat": F.concat,
    "map_transform_values": F.transform_values,
    "random": F.rand,
    "sha": F.sha1,
    "struct_pack": F.named_struct,
    "len": F.length,
    "list_sort": F.sort_array,
    "list_contains": F.array_contains,
    "string_split": F.split,
    "quantile_cont": F.percentile,
    "arg_max": F.max_by,
    "arg_min": F.min_by,
    "space": lambda n: F.call_function("space", n),
    "map": F.create_map,
}


def function(name: str) -> Callable[..., Column]:
    """The function of that name, in any case; unknown names go to SQL."""
    key = name.lower()
    if key in ALIASES:
        return ALIASES[key]
    if callable(found := getattr(F, key, None)):
        return found
    return lambda *args: F.call_function(key, *args)


def exists(spark: SparkSession, name: str) -> bool:
    return name.lower() in ALIASES or hasattr(F, name.lower()) or spark.catalog.functionExists(name)
