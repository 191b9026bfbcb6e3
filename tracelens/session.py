"""Session settings for local work; on a cluster the submitter's settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tracelens").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", True).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", False).config("spark.ui.showConsoleProgress", False).getOrCreate()
    )
