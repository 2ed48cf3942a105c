"""The session the engine is meant to run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The engine follows non-ANSI Spark semantics: failed casts and divisions by zero give null.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("tessera").config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in (SETTINGS | extra).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
