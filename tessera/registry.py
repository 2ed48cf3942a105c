"""How queries are declared: a function or SQL text, and the SQL that an independent engine runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """ANSI mode off while a plan is analysed; expressions keep the mode they were made in."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL text over the tables it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def add(name: str, query: Query, oracle: str | None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with lenient(spark):
            return query(spark, sf_dir)

    run.__name__ = name
    _QUERIES[name] = run
    if oracle:
        _ORACLE[name] = oracle


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name."""

    def wrap(f: Query) -> Query:
        add(name or f.__name__, f, oracle)
        return f

    return wrap


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL text; the oracle runs the same text unless its dialect needs another."""
    add(name, lambda spark, sf_dir: run_sql(spark, sf_dir, text), oracle or text)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
