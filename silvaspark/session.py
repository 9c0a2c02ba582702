"""Session settings that suit these operators; everything else is left to the cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def builder(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    b = (
        SparkSession.builder.appName("silvaspark")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("SILVASPARK_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false")
    return b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b
