"""Sort, limit, top-k and exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, sql, table

sql("sort_global", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
sql("sort_nulls_first_limit", "SELECT k, c_custkey FROM (SELECT CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS k, c_custkey FROM customer) t ORDER BY k ASC NULLS FIRST, c_custkey LIMIT 50")
sql("sort_nulls_last_limit", "SELECT k, c_custkey FROM (SELECT CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS k, c_custkey FROM customer) t ORDER BY k DESC NULLS LAST, c_custkey LIMIT 50")
sql("topk_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
sql("limit_of_sorted_subquery", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 77) t")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 123) t")
def limit_local_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").limit(123).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC LIMIT 5")
def collect_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five rows in order, as a reversed top-k rather than through the driver."""
    return table(spark, sf_dir, "nation").orderBy(F.desc("n_nationkey")).limit(5).select("n_nationkey", "n_name")


@query("SELECT TRUE AS ordered")
def sort_within_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").repartition(4, "c_nationkey").sortWithinPartitions("c_acctbal")
    w = F.expr("lag(c_acctbal) OVER (PARTITION BY p ORDER BY i)")
    seen = rows.select("c_acctbal", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).select((F.coalesce(w, F.col("c_acctbal")) <= F.col("c_acctbal")).alias("ok"))
    return seen.agg(F.bool_and("ok").alias("ordered"))


def _exchanged(kind: str, shuffle) -> None:
    @query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders", name=f"exchange_{kind}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shuffle(table(spark, sf_dir, "orders")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


_exchanged("hash", lambda d: d.repartition(6, "o_custkey"))
_exchanged("range", lambda d: d.repartitionByRange(6, "o_orderdate"))
_exchanged("round_robin", lambda d: d.repartition(6))
_exchanged("single", lambda d: d.repartition(1))
_exchanged("coalesce", lambda d: d.coalesce(2))
_exchanged("rebalance_hint", lambda d: d.hint("rebalance", "o_custkey"))
