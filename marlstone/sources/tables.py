"""The driver's Parquet tables as lazily read attributes and temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """``t.orders`` is the table; ``t.sql`` runs SQL that names the tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for name in sorted(set(re.findall(r"\w+", text)) & set(NAMES)):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)
