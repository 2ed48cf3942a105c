"""Projection, filters and operators that change the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, sql, table

sql("project", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
sql("project_nested_case", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS level FROM customer")
sql("filter_three_valued", "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS k FROM customer) t WHERE k > 10 OR NOT (k <> 3)")
sql("filter_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9, 13, 17, 21, 25, 29, 33, 37, 41, 45)")
sql("filter_not_in_list", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 9)")
sql("filter_pushed_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-04-01 00:00:00'")
sql("filter_like_chain", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'PROMO%'")
sql("project_array_struct_fields", "SELECT c_custkey, array_join(transform(x.q, e -> CAST(e AS STRING)), ',') AS q FROM (SELECT c_custkey, transform(sequence(1, 3), i -> named_struct('p', i, 'q', c_nationkey + i)) AS x FROM customer) t",
    "SELECT c_custkey, array_to_string([CAST(c_nationkey + i AS VARCHAR) for i in [1, 2, 3]], ',') AS q FROM customer")
sql("project_raise_error", "SELECT c_custkey, CASE WHEN c_custkey < 0 THEN raise_error('a negative key') ELSE c_name END AS v FROM customer", "SELECT c_custkey, c_name AS v FROM customer")
sql("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
sql("generate_explode", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, explode(split(text, '\\n')) AS line FROM documents) t GROUP BY doc_id",
    "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t GROUP BY doc_id")
sql("generate_posexplode", "SELECT vec_id, pos, round(v, 5) AS v FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings) t",
    "SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(embedding[i], 5) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) t")
sql("generate_stack", "SELECT n_nationkey, k, v FROM nation LATERAL VIEW stack(2, 'key', CAST(n_nationkey AS STRING), 'name', n_name) t AS k, v",
    "SELECT n_nationkey, 'key' AS k, CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT n_nationkey, 'name', n_name FROM nation")
sql("generate_inline", "SELECT r_regionkey, a, b FROM region LATERAL VIEW inline(array(struct(r_name AS a, 1 AS b), struct('x' AS a, 2 AS b))) t AS a, b",
    "SELECT r_regionkey, r_name AS a, 1 AS b FROM region UNION ALL SELECT r_regionkey, 'x', 2 FROM region")
sql("generate_json_tuple", "SELECT event_id, k FROM events LATERAL VIEW json_tuple(props, 'k') t AS k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
sql("generate_outer", "SELECT n_nationkey, v FROM nation LATERAL VIEW OUTER explode(CASE WHEN n_nationkey % 2 = 0 THEN array(1, 2) END) t AS v",
    "SELECT n_nationkey, v FROM nation, (SELECT unnest([1, 2]) AS v) t WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 1")
sql("generate_explode_outer", "SELECT r_regionkey, v FROM region LATERAL VIEW explode_outer(CASE WHEN r_regionkey > 2 THEN array(1, 2) END) t AS v",
    "SELECT r_regionkey, v FROM region, (SELECT unnest([1, 2]) AS v) t WHERE r_regionkey > 2 UNION ALL SELECT r_regionkey, NULL FROM region WHERE r_regionkey <= 2")
sql("generate_posexplode_outer", "SELECT r_regionkey, p, v FROM region LATERAL VIEW posexplode_outer(CASE WHEN r_regionkey > 2 THEN array('a', 'b') END) t AS p, v",
    "SELECT r_regionkey, p, v FROM region, (VALUES (0, 'a'), (1, 'b')) t(p, v) WHERE r_regionkey > 2 UNION ALL SELECT r_regionkey, NULL, NULL FROM region WHERE r_regionkey <= 2")
sql("generate_inline_outer", "SELECT r_regionkey, a FROM region LATERAL VIEW inline_outer(CASE WHEN r_regionkey > 2 THEN array(struct(r_name AS a)) END) t AS a",
    "SELECT r_regionkey, CASE WHEN r_regionkey > 2 THEN r_name END AS a FROM region")
sql("generate_explode_map", "SELECT r_regionkey, k, v FROM region LATERAL VIEW explode(map('n', r_name, 'x', 'y')) t AS k, v",
    "SELECT r_regionkey, 'n' AS k, r_name AS v FROM region UNION ALL SELECT r_regionkey, 'x', 'y' FROM region")
sql("unpivot", "SELECT * FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR k IN (size, price))",
    "SELECT p_partkey, 'size' AS k, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")


@query("SELECT n_nationkey FROM nation, range(100) t(i) WHERE i < n_nationkey")
def replicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as often as its first column says."""
    rows = table(spark, sf_dir, "nation").where("n_nationkey > 0")
    return rows.select("n_nationkey", F.explode(F.sequence(F.lit(1), F.col("n_nationkey")))).select("n_nationkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def expand_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What grouping sets expand to: a row for each projection."""
    rows = table(spark, sf_dir, "lineitem")
    both = F.array(F.struct(F.col("l_returnflag").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("g")), F.struct(F.lit(None).cast("string").alias("a"), F.col("l_linestatus").alias("b"), F.lit(1).alias("g")))
    return rows.select(F.explode(both).alias("e")).groupBy("e.a", "e.b", "e.g").agg(F.count("*").alias("n")).selectExpr("a AS l_returnflag", "b AS l_linestatus", "n")


@query("SELECT TRUE AS near")
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement is about as large as asked for."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.sample(0.1, seed=3).agg(F.count("*").alias("n")).crossJoin(rows.agg(F.count("*").alias("m"))).select((F.abs(F.col("n") / F.col("m") - 0.1) < 0.02).alias("near"))


@query("SELECT TRUE AS same")
def transition_rows_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to Arrow batches and back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    there = rows.mapInArrow(lambda batches: batches, rows.schema).agg(F.sum("c_custkey").alias("a"))
    return there.crossJoin(rows.agg(F.sum("c_custkey").alias("b"))).select((F.col("a") == F.col("b")).alias("same"))
