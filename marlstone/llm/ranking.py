"""Distributed gapless numbering of rows within groups that may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_runs(rows: DataFrame, group: str, coarse: str, order: list[str]) -> DataFrame:
    """One row per distinct input row, with ``__start`` and ``__m``.

    Identical rows are interchangeable, so they are counted (``__m``) with
    map-side partial sums and share the numbers ``__start .. __start+__m-1``.
    Numbers run from 0 in each ``group`` by (``coarse``, ``order``).  ``coarse``
    cuts a group into pieces of bounded size; only sums per piece are
    prefix-summed over a whole group, so a group holding a third of all rows
    still spreads over many tasks.  Group and coarse must not be null.
    """
    keys = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__m"))
    pieces = keys.groupBy(group, coarse).agg(F.sum("__m").alias("__n"))
    before = Window.partitionBy(group).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(group, coarse, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = (
        Window.partitionBy(group, coarse)
        .orderBy(*[F.asc_nulls_first(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return keys.join(pieces, [group, coarse]).select(
        *rows.columns,
        (F.col("__base") + F.coalesce(F.sum("__m").over(inside), F.lit(0))).alias("__start"),
        "__m",
    )


def expanded(runs: DataFrame, number: str) -> DataFrame:
    """Each original row again, with its own number."""
    return runs.withColumn(
        number, F.explode(F.sequence(F.col("__start"), F.col("__start") + F.col("__m") - 1))
    ).drop("__start", "__m")


def piece_bits(rows: int, piece: int = 50_000) -> int:
    """Bits of a hash that cut ``rows`` rows into pieces of about ``piece``."""
    return max(0, (max(rows, 1) // piece).bit_length())
