"""Session construction with the settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "marlstone",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution, ANSI mode and a UTC time zone.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where the
    submitter decides them; tests pass ``local[n]`` and a small count.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        builder = builder.master(master)
        settings["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
