"""Logical rewrites that the optimizer doesn't make by itself, each beside its plain form in the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, table


def single_scan_union(rows: DataFrame, branches: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """A union of aggregates over filters of one table, as one scan with masked aggregates."""
    masked, names = [], []
    for label, (where, aggs) in branches.items():
        for k, agg in enumerate(aggs):
            masked.append(agg(where).alias(f"{label}_{k}"))
        names.append(F.struct(F.lit(label).alias("branch"), *[F.col(f"{label}_{k}").alias(f"v{k}") for k in range(len(aggs))]))
    return rows.agg(*masked).select(F.explode(F.array(*names)).alias("r")).select("r.*")


@query(
    """SELECT 'low' AS branch, count(*) AS v0, round(avg(l_extendedprice), 4) AS v1 FROM lineitem WHERE l_quantity < 10
    UNION ALL SELECT 'mid', count(*), round(avg(l_extendedprice), 4) FROM lineitem WHERE l_quantity BETWEEN 10 AND 30
    UNION ALL SELECT 'high', count(*), round(avg(l_extendedprice), 4) FROM lineitem WHERE l_quantity > 30"""
)
def rewrite_single_scan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    aggs = [lambda w: F.count_if(w), lambda w: F.round(F.avg(F.when(w, F.col("l_extendedprice"))), 4)]
    return single_scan_union(table(spark, sf_dir, "lineitem"), {"low": (q < 10, aggs), "mid": (q.between(10, 30), aggs), "high": (q > 30, aggs)})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rewrite_aggregate_before_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate by all keys first, then expand the few groups to the sets of the cube."""
    fine = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return fine.cube("l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"), F.sum("q").cast("long").alias("q"))


@query("SELECT c_nationkey, CAST(sum(o_cnt) AS BIGINT) AS n FROM customer JOIN (SELECT o_custkey, count(*) AS o_cnt FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey GROUP BY c_nationkey")
def rewrite_aggregate_before_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are counted by customer before the join, so a row a customer moves."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("n").alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS hi FROM orders GROUP BY o_custkey")
def rewrite_join_of_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aggregates by the same key that would be joined, as one aggregate."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("hi"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.missing') AS b FROM events")
def rewrite_merged_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several paths of one document are parsed once."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string, missing string").alias("j")).select("event_id", F.col("j.k").alias("a"), F.col("j.missing").alias("b"))


@query("SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = TIMESTAMP '1996-03-01 00:00:00'")
def rewrite_date_trunc_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition on a truncated date as a range that reaches the scan."""
    return table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1996-04-01 00:00:00'").select("o_orderkey")
