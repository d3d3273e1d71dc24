"""A local session with the settings the library assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("evidor")
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
