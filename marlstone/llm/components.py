"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, new_path

MAX_ROUNDS = 60


def _stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(root.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and is not its own root.

    ``edges`` has the long columns a and b.  The root of a component is its
    smallest node.  Every round writes its edges to the shared folder, so no
    lineage builds up; rounds end when the edges no longer change.
    """
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, path = _stage(current, "stars")
    total = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    seen = current.agg(total.alias("x")).first().x
    for _ in range(MAX_ROUNDS):
        if not seen.n:
            break
        after, new = _stage(_stars(current), "stars")
        now = after.agg(total.alias("x")).first().x
        delete_path(current.sparkSession, path)
        current, path = after, new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
