"""Readers and writers with explicit formats, schemas and options."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SUFFIXES = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".orc": "orc", ".txt": "text"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def format_of(path: str) -> str:
    """The format by extension; Parquet where it is unknown."""
    return SUFFIXES.get(os.path.splitext(path.rstrip("/"))[1].lower(), "parquet")


def read(spark: SparkSession, *paths: str, format: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """Read files, folders (nested ones too) or globs of one format.

    CSV and TSV have a header and inferred types unless options say otherwise;
    give ``schema`` in production, as inference reads the data once more.
    """
    kind = format or format_of(paths[0])
    reader = spark.read.format(kind).option("recursiveFileLookup", "true")
    if kind == "csv":
        reader = reader.option("header", "true").option("inferSchema", str(schema is None).lower())
        if paths[0].lower().endswith(".tsv"):
            reader = reader.option("sep", "\t")
    for key, value in options.items():
        reader = reader.option(key, value)
    return (reader.schema(schema) if schema else reader).load(list(paths))


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", partition_by: tuple = (), **options) -> None:
    """Write with a real save mode, partition columns and options."""
    kind = format or format_of(path)
    writer = df.write.format(kind).mode(mode)
    if kind == "csv" and "header" not in options:
        writer = writer.option("header", "true")
    for key, value in options.items():
        writer = writer.option(key, value)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
