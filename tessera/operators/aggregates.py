"""Aggregation: grouping, masks, distinct, grouping sets, sketches and first-N-per-group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, sql, table

sql("agg_hash_grouped", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("agg_global", "SELECT count(*) AS n, round(avg(l_quantity), 6) AS a, min(l_tax) AS lo FROM lineitem")
sql("agg_global_empty_input", "SELECT count(*) AS n, max(l_tax) AS hi FROM lineitem WHERE l_quantity < 0")
sql("agg_grouped_empty_input", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
sql("agg_filter_mask", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS t FROM lineitem GROUP BY l_returnflag")
sql("agg_expression_keys", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)")
sql("agg_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600")
sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag")
sql("agg_multi_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d1, count(DISTINCT l_partkey) AS d2, count(*) AS n FROM lineitem GROUP BY l_returnflag")
sql("agg_distinct_sum", "SELECT o_orderstatus, sum(DISTINCT o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
sql("agg_distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
sql("agg_count_multi_column", "SELECT count(a, b) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 1 END AS a, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS b FROM customer) t",
    "SELECT count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 1 END AS a, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS b FROM customer) t")
_SETS = "SELECT l_returnflag, l_linestatus, count(*) AS n, {g} AS g FROM lineitem GROUP BY {s}"
_G = "CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT)"
sql("agg_grouping_sets", _SETS.format(g=_G, s="GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
sql("agg_rollup", _SETS.format(g=_G, s="ROLLUP (l_returnflag, l_linestatus)"))
sql("agg_cube", _SETS.format(g=_G, s="CUBE (l_returnflag, l_linestatus)"))
sql("agg_grouping_function", _SETS.format(g="CAST(grouping(l_linestatus) AS BIGINT)", s="ROLLUP (l_returnflag, l_linestatus)"))
sql("agg_struct_ordering", "SELECT c_mktsegment, max(struct(c_acctbal, c_custkey)).c_custkey AS k FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, max({'a': c_acctbal, 'k': c_custkey}).k AS k FROM customer GROUP BY c_mktsegment")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey")
def agg_sorted_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregation over input that is sorted by its keys already."""
    rows = table(spark, sf_dir, "customer").repartition("c_mktsegment", "c_nationkey").sortWithinPartitions("c_mktsegment", "c_nationkey")
    return rows.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def agg_two_phase_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hot key aggregated in two steps, by salt and then without."""
    rows = table(spark, sf_dir, "lineitem").withColumn("salt", F.pmod(F.xxhash64("l_orderkey"), F.lit(16)))
    part = rows.groupBy("l_suppkey", "salt").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return part.groupBy("l_suppkey").agg(F.sum("q").cast("long").alias("q"), F.sum("n").alias("n"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t WHERE r <= 3")
def agg_group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First N of a group by an aggregate whose state is N rows, so groups are cut before they move."""
    best = F.expr("slice(sort_array(collect_list(struct(-c_acctbal AS a, c_custkey AS k)), true), 1, 3)")
    rows = table(spark, sf_dir, "customer").withColumn("salt", F.pmod(F.col("c_custkey"), F.lit(16)))
    part = rows.groupBy("c_nationkey", "salt").agg(best.alias("b")).select("c_nationkey", F.explode("b").alias("b")).select("c_nationkey", F.col("b.a").alias("a"), F.col("b.k").alias("k"))
    top = part.groupBy("c_nationkey").agg(F.expr("slice(sort_array(collect_list(struct(a, k)), true), 1, 3)").alias("b"))
    return top.select("c_nationkey", F.explode("b").alias("b")).select("c_nationkey", F.col("b.k").alias("c_custkey"), (-F.col("b.a")).alias("c_acctbal"))


@query("SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS F, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS O FROM lineitem GROUP BY l_returnflag")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) t")
def agg_drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").dropDuplicates(["c_nationkey", "c_mktsegment"]).agg(F.count("*").alias("n"))


@query("SELECT TRUE AS within")
def agg_approx_distinct_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch lies within 5 percent of the exact count.

    Both are taken of the distinct keys: beside count(DISTINCT) Spark would shuffle a sketch for each key.
    """
    keys = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return keys.agg((F.abs(F.approx_count_distinct("o_custkey", 0.01) / F.count("o_custkey") - 1) < 0.05).alias("within"))
