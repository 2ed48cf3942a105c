"""User-defined functions: vectorised scalar, grouped, map, aggregate, table and SQL functions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, table


@query("SELECT c_custkey, round(c_acctbal * 2 + 1, 4) AS v FROM customer")
def udf_pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.pandas_udf(lambda x: (x * 2 + 1).round(4), "double")
    return table(spark, sf_dir, "customer").select("c_custkey", twice("c_acctbal").alias("v"))


@query("SELECT c_custkey, upper(c_name) AS v FROM customer")
def udf_arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    def up(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_upper(b.column(1))], ["c_custkey", "v"])

    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").mapInArrow(up, "c_custkey long, v string")


@query("SELECT c_custkey, c_custkey % 7 AS v FROM customer")
def udf_row_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.udf(lambda k: k % 7, "long")("c_custkey").alias("v"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 100")
def udf_map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rows.mapInPandas(lambda frames: (f[f.c_acctbal > 100][["c_custkey", "c_name"]] for f in frames), "c_custkey long, c_name string")


@query("SELECT c_nationkey, count(*) AS n, round(max(c_acctbal), 2) AS hi FROM customer GROUP BY c_nationkey")
def udf_apply_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_nationkey": [g.c_nationkey.iloc[0]], "n": [len(g)], "hi": [round(g.c_acctbal.max(), 2)]})

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").applyInPandas(f, "c_nationkey int, n long, hi double")


@query("SELECT n_nationkey, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS BIGINT) AS n FROM nation")
def udf_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n_nationkey": a.n_nationkey, "n": len(b)})

    left = table(spark, sf_dir, "nation").select("n_nationkey").groupBy("n_nationkey")
    right = table(spark, sf_dir, "customer").select("c_nationkey").groupBy("c_nationkey")
    return left.cogroup(right).applyInPandas(f, "n_nationkey int, n long")


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY c_nationkey")
def udf_pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(mean("c_acctbal"), 4).alias("v"))


@query("SELECT r_regionkey, CAST(i AS INT) AS i FROM region, range(3) t(i)")
def udtf_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="i int")
    class Count:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("tessera_count", Count)
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    return spark.sql("SELECT r_regionkey, t.i FROM region, LATERAL tessera_count(3) t")


@query("SELECT p_partkey, round(p_retailprice * 1.19, 5) AS gross FROM part")
def udf_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_gross(x DOUBLE) RETURNS DOUBLE RETURN round(x * 1.19, 5)")
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, tessera_gross(p_retailprice) AS gross FROM part")


@query("SELECT c_custkey, CAST(length(c_name) AS INT) AS v FROM customer")
def udf_name_mapped_to_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that users know by another name, bound to the built-in one so it stays in generated code."""
    known = {"my_len": F.length}
    return table(spark, sf_dir, "customer").select("c_custkey", known["my_len"]("c_name").alias("v"))
