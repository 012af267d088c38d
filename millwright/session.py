"""SparkSession with the settings that the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, cores: int | None = None, **settings: str) -> SparkSession:
    """A session; on one machine, as many shuffle partitions as cores."""
    builder = SparkSession.builder.appName("millwright")
    if master or cores:
        builder = builder.master(master or f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores or os.cpu_count()))
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
