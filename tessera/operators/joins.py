"""Joins: every kind and strategy, as-of, range and bloom-filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.registry import query, sql, table

_CO = "customer.c_custkey = orders.o_custkey AND o_totalprice > 100000"

sql("join_inner_shuffle_hash", f"SELECT /*+ SHUFFLE_HASH(customer) */ c_custkey, o_orderkey FROM customer JOIN orders ON {_CO}")
sql("join_sort_merge", f"SELECT /*+ MERGE(customer) */ c_custkey, o_orderkey FROM customer JOIN orders ON {_CO}")
sql("join_broadcast_hash", "SELECT /*+ BROADCAST(nation) */ c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
sql("join_left_outer", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON {_CO}")
sql("join_right_outer", f"SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON {_CO}")
sql("join_full_outer", f"SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON {_CO}")
sql("join_left_semi", f"SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON {_CO}", f"SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON {_CO}")
sql("join_left_anti", f"SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON {_CO}", f"SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON {_CO}")
sql("join_existence", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') OR c_acctbal > 9000 AS flagged FROM customer")
sql("join_residual_condition", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 3")
sql("join_nested_loop_inner", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_acctbal > n_nationkey * 350")
sql("join_nested_loop_left", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_nationkey > r_regionkey * 6 + 3")
sql("join_nested_loop_semi", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey * 400 > s_acctbal)")
sql("join_nested_loop_full", "SELECT n_nationkey, r_regionkey FROM nation FULL JOIN region ON n_regionkey + r_regionkey > 7 AND n_nationkey > 10")
sql("join_cartesian_regions", "SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 CROSS JOIN region r2")
sql("join_null_safe_equal", "SELECT a.k AS ak, b.k AS bk FROM (SELECT CASE WHEN c_nationkey > 3 THEN c_nationkey END AS k, c_custkey FROM customer) a JOIN (SELECT CASE WHEN n_nationkey > 5 THEN n_nationkey END AS k FROM nation) b ON a.k <=> b.k",
    "SELECT a.k AS ak, b.k AS bk FROM (SELECT CASE WHEN c_nationkey > 3 THEN c_nationkey END AS k, c_custkey FROM customer) a JOIN (SELECT CASE WHEN n_nationkey > 5 THEN n_nationkey END AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
sql("join_using_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql("join_lateral", "SELECT n_nationkey, t.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 8000) t")
sql("join_any_dedup", "SELECT o_orderkey, t.m FROM orders LEFT JOIN (SELECT c_custkey, max(c_acctbal) AS m FROM customer GROUP BY c_custkey) t ON o_custkey = t.c_custkey")


def null_aware_anti(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of left whose key is NOT IN right's: none if one of those is null, and a null key only beside none at all.

    Spark runs NOT IN as a broadcast of the whole right side, which the driver must hold. Here its distinct
    keys are shuffled, and only a row with their number and their nulls is broadcast.
    """
    keys = right.select(F.col(other).alias("_key"))
    facts = keys.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_key").isNull()).alias("_nulls"))
    rows = left.crossJoin(F.broadcast(facts)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull()))
    return rows.join(keys.distinct().hint("merge"), F.col(key) == F.col("_key"), "left_anti").drop("_n", "_nulls")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_partkey > 10 THEN l_partkey ELSE 11 END FROM lineitem)")
def join_null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select(F.expr("CASE WHEN l_partkey > 10 THEN l_partkey ELSE 11 END AS k"))
    return null_aware_anti(table(spark, sf_dir, "part").select("p_partkey"), keys, "p_partkey", "k")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_partkey > 10 THEN l_partkey END FROM lineitem)")
def join_null_aware_anti_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select(F.expr("CASE WHEN l_partkey > 10 THEN l_partkey END AS k"))
    return null_aware_anti(table(spark, sf_dir, "part").select("p_partkey"), keys, "p_partkey", "k")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, keys: tuple[str, ...] = (), spread: int = 16) -> DataFrame:
    """Inner join on low <= point <= high: intervals are filed under each bin of ``width`` they touch.

    The equi-join on the bin replaces a nested loop; an interval costs a row a bin and spread, and pairs that don't
    match are about width / length of those that do, so width should be a fraction of the usual length of an interval.
    Points of a bin are spread over ``spread`` groups, so few bins or keys still make many even tasks. Their number
    is fixed, as the pairs that come out, not the bytes that go in, are the work.
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    on = ["_bin", "_part", *keys]
    bin_ = lambda c: F.floor(F.col(c) / width)
    a = left.select("*", bin_(point).alias("_bin"), F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int").alias("_part"))
    b = right.repartition(tasks, *right.columns).select("*", F.explode(F.sequence(bin_(low), bin_(high))).alias("_bin")).select("*", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_part"))
    pairs = a.repartition(tasks, *on).join(b.repartition(tasks, *on).hint("merge"), on)
    return pairs.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bin", "_part")


@query("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice / 100 BETWEEN s_acctbal AND s_acctbal + 25")
def join_interval_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("v"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 25).alias("hi"))
    return range_join(left, right, "v", "lo", "hi", 5.0).select("o_orderkey", "s_suppkey")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_nationkey = p_size AND p_retailprice BETWEEN s_acctbal - 500 AND s_acctbal + 500")
def join_range_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("k"), "p_retailprice")
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_acctbal") - 500).alias("lo"), (F.col("s_acctbal") + 500).alias("hi"))
    return range_join(left, right, "p_retailprice", "lo", "hi", 100.0, ("k",)).select("s_suppkey", "p_partkey")


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Both sides are unioned and carried forward in one window by key: one shuffle, sorted runs, no join
    that multiplies rows. Hot keys are a sorted stream, not a group held in memory.
    """
    packed = F.struct(F.col(right_time).alias("_at"), *take)
    a = left.withColumn("_t", F.col(left_time)).withColumn("_r", F.lit(None).cast(right.select(packed.alias("x")).schema[0].dataType)).withColumn("_side", F.lit(1))
    b = right.select(F.col(on), F.col(right_time).alias("_t"), packed.alias("_r"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in take])


@query(
    """SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN
    (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return asof_join(left, right, "user_id", "ts", "ts", ["last_value"]).select("event_id", "last_value")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9500 AND c_mktsegment = 'MACHINERY'")
def join_runtime_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selective side; Spark adds the bloom filter by itself beyond its size thresholds."""
    small = table(spark, sf_dir, "customer").where("c_acctbal > 9500 AND c_mktsegment = 'MACHINERY'")
    return table(spark, sf_dir, "orders").join(small, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT l_suppkey, count(*) AS n, round(sum(s_acctbal), 2) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey")
def join_salted_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hot key spread over salts: the small side is repeated once a salt."""
    salts = 8
    left = table(spark, sf_dir, "lineitem").select("l_suppkey", F.pmod(F.col("l_orderkey"), F.lit(salts)).cast("int").alias("salt"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt2"))
    joined = left.join(right.hint("shuffle_hash"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("salt") == F.col("salt2")))
    return joined.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("v"))
