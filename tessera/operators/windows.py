"""Window operators: ranking, offsets, frames, group limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, sql, table

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _window(name: str, expr: str, oracle: str | None = None) -> None:
    text = "SELECT o_orderkey, {} AS v FROM orders"
    sql(f"window_{name}", text.format(expr), text.format(oracle or expr))


for _n in ("row_number", "rank", "dense_rank"):
    _window(_n, f"CAST({_n}() {_W}) AS BIGINT)")
_window("rank_with_ties", "CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT)")
_window("dense_rank_with_ties", "CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT)")
_window("percent_rank", f"round(percent_rank() {_W}), 8)")
_window("cume_dist", f"round(cume_dist() {_W}), 8)")
_window("ntile", f"CAST(ntile(4) {_W}) AS BIGINT)")
_window("lag", f"lag(o_totalprice, 1) {_W})")
_window("lag_default", f"lag(o_totalprice, 2, 0.0) {_W})")
_window("lead", f"lead(o_totalprice, 1) {_W})")
_window("nth_value", f"nth_value(o_totalprice, 2) {_W})")
_window("first_value", f"first_value(o_totalprice) {_W})")
_window("last_value_full", f"last_value(o_totalprice) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_window("ignore_nulls", f"last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS {_W})", f"last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) {_W})")
_window("running_sum", f"round(sum(o_totalprice) {_W}), 2)")
_window("rows_frame", f"round(avg(o_totalprice) {_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4)")
_window("rows_following", f"count(*) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
_window("range_frame", "count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)")
_window("range_current", "count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)")
_window("whole_partition", "max(o_totalprice) OVER (PARTITION BY o_custkey)")
_window("count_distinct_via_set", "size(collect_set(o_orderpriority) OVER (PARTITION BY o_custkey))", "CAST(count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS INT)")
sql("window_group_limit", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) t WHERE r <= 2")
sql("window_multiple_specs", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS a, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS b FROM orders")


@query("SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey")
def window_first_row_as_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a partition by min_by, which combines before the shuffle, instead of a window."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_key"))


@query("SELECT user_id, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) AS BIGINT) AS sessions FROM (SELECT user_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, TRUE) AS gap FROM events) t GROUP BY user_id")
def window_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.coalesce(F.expr("ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTES"), F.lit(True))
    return table(spark, sf_dir, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.sum(F.when(F.col("gap"), 1).otherwise(0)).alias("sessions"))


@query("SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start, count(*) AS n FROM events GROUP BY 1")
def window_time_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window and window_time over a batch: the time of a window is just before its end."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts")).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select((F.unix_seconds(F.window_time("w")) + 1 - 3600).alias("start"), "n")


@query("SELECT count(*) AS sessions, CAST((SELECT count(*) FROM events) AS BIGINT) AS n FROM (SELECT coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, TRUE) AS gap FROM events) t WHERE gap")
def window_session_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT TRUE AS near")
def window_sketch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of parts, merged, estimate the whole."""
    part = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.hll_sketch_agg("o_custkey").alias("h"))
    exact = table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("n"))
    return part.agg(F.hll_sketch_estimate(F.hll_union_agg("h")).alias("e")).crossJoin(exact).select((F.abs(F.col("e") / F.col("n") - 1) < 0.05).alias("near"))
