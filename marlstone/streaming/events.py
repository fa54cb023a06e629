"""Event streams: sources, watermarked windows and bounded runs."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from ..sources.tables import Tables


def event_stream(tables: Tables, name: str = "events", ts: str = "ts") -> DataFrame:
    """The table as a file stream with an event time that can be watermarked.

    Watermarks need a time with zone, so the zone-less column is cast.
    """
    batch, path = getattr(tables, name), f"{tables.folder}/{name}.parquet"
    reader = tables.spark.readStream.schema(batch.schema)
    if batch.inputFiles()[0].endswith(f"/{name}.parquet"):  # one file, not a folder of files
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), tables.folder
    stream = reader.parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def late_tolerant_counts(events: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; rows later than ``late`` are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def interval_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, within: str, late: str = "1 day") -> DataFrame:
    """Rows of two streams with equal keys, the right one at most ``within`` after the left.

    Both watermarks and the time bound let Spark drop state that can meet no more rows.
    """
    left = left.withWatermark(left_ts, late).withColumnRenamed(by, "__by")
    right = right.withWatermark(right_ts, late)
    time = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col("__by") == F.col(by)) & time).drop("__by")


def running_tops(events: DataFrame) -> DataFrame:
    """(user_id, n, top) so far, from state that is kept by user."""

    def update(key, batches, state):
        n, top = state.get if state.exists else (0, float("-inf"))
        for pdf in batches:
            n, top = n + len(pdf), max(top, float(pdf.value.max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    rows = events.select("user_id", "value").groupBy("user_id")
    return rows.applyInPandasWithState(update, "user_id long, n long, top double", "n long, top double", "update", "NoTimeout")


def available_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result."""
    name = f"result_{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", scratch(stream.sparkSession, "stream"))
        .start()
    )
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return stream.sparkSession.table(name)
