"""Sinks: partitioned, bucketed, sorted and optimised writes, appends, and the no-op sink."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, table


def out(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that executors share; one in the temporary folder if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = Path(tempfile.gettempdir(), "tessera-shared").as_uri()
        os.makedirs(base.removeprefix("file://"), exist_ok=True)
    return f"{base.rstrip('/')}/sink-{name}-{uuid.uuid4().hex}"


_ALL = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def _written(name: str, write) -> None:
    @query(_ALL, name=f"sink_{name}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = out(spark, name)
        write(_rows(spark, sf_dir), path)
        return spark.read.format("orc" if name == "orc" else "parquet").load(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


_written("parquet", lambda d, p: d.write.option("compression", "zstd").parquet(p))
_written("orc", lambda d, p: d.write.orc(p))
_written("partitioned", lambda d, p: d.repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(p))
_written("append", lambda d, p: (d.where("o_orderkey % 2 = 0").write.parquet(p), d.where("o_orderkey % 2 = 1").write.mode("append").parquet(p)))
_written("rebalanced", lambda d, p: d.hint("rebalance").write.parquet(p))
_written("range_sorted", lambda d, p: d.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(p))


@query(_ALL)
def sink_bucketed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucketed and sorted by key, so that joins on it need no shuffle."""
    name = f"tessera_bucketed_{uuid.uuid4().hex[:8]}"
    _rows(spark, sf_dir).write.bucketBy(4, "o_orderkey").sortBy("o_orderkey").option("path", out(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


@query("SELECT count(*) AS n FROM orders")
def sink_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    rows.write.format("noop").mode("overwrite").save()
    return rows.agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus UNION ALL SELECT 'F', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def sink_dynamic_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the partitions that are written again are replaced."""
    path = out(spark, "dynamic")
    rows = _rows(spark, sf_dir)
    rows.write.partitionBy("o_orderstatus").parquet(path)
    rows.where("o_orderstatus = 'F' AND o_totalprice > 1000").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def optimize(spark: SparkSession, path: str, to: str, keys: list[str], files: int) -> None:
    """Compact a folder into so many files sorted by keys, for min/max pruning on them."""
    spark.read.parquet(path).repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(to)


@query(_ALL)
def sink_optimize_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, to = out(spark, "many"), out(spark, "compact")
    _rows(spark, sf_dir).repartition(16).write.parquet(path)
    optimize(spark, path, to, ["o_orderkey"], 2)
    return spark.read.parquet(to)
