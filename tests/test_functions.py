import duckdb

from tessera import catalog


def test_format_string_with_long_and_null_keys(spark, tmp_path):
    rows = [(7, "A"), (99999, "B"), (100000, "C"), (899999, "D"), (-3, "E"), (5, None), (None, "F")]
    customers = spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").selectExpr("*", "'' AS c_name", "0D AS c_acctbal", "0 AS c_nationkey")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.queries()["fn_format_string"](spark, str(tmp_path)).select("k", "v").collect()]
    assert sorted(got, key=repr) == sorted(con.execute(catalog.oracle_sql()["fn_format_string"]).fetchall(), key=repr)
