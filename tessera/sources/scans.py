"""Sources: files of every built-in format, ranges, literal rows, caches and input-file metadata.

Table formats and brokers that need a package beyond Spark's own (``CONNECTORS``) are read through
``connector``, which says what is missing instead of failing inside a job.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, sql, table
from tessera.sources.sinks import out

sql("scan_parquet_pruned", "SELECT l_orderkey, l_tax FROM lineitem WHERE l_quantity > 45")
sql("scan_count_only", "SELECT count(*) AS n FROM lineitem")
sql("scan_nested_column", "SELECT vec_id, size(embedding) AS n FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n FROM embeddings")

#: Formats of outside packages: the class that shows they are installed.
CONNECTORS = {
    "delta": "io.delta.sql.DeltaSparkSessionExtension",
    "iceberg": "org.apache.iceberg.spark.SparkCatalog",
    "hudi": "org.apache.hudi.DefaultSource",
    "kafka": "org.apache.spark.sql.kafka010.KafkaSourceProvider",
}


class MissingConnector(RuntimeError):
    pass


def connector(spark: SparkSession, name: str, streaming: bool = False):
    """A reader for an outside format, if its package is on the class path."""
    try:
        spark._jvm.java.lang.Class.forName(CONNECTORS[name], False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception as e:
        raise MissingConnector(f"{name} needs {CONNECTORS[name]} on the class path (spark.jars.packages)") from e
    return (spark.readStream if streaming else spark.read).format(name)


def _through(fmt: str, columns: str, oracle: str, schema: str | None = None, **options: str) -> None:
    @query(oracle, name=f"scan_{fmt}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = out(spark, fmt)
        table(spark, sf_dir, "customer").selectExpr(*columns.split("; ")).write.mode("overwrite").options(**options).format(fmt).save(path)
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).format(fmt).load(path)


_FLAT = "c_custkey; c_name; c_acctbal; c_mktsegment"
_SELECT = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"
_SCHEMA = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"
_through("orc", _FLAT, _SELECT)
_through("csv", _FLAT, _SELECT, _SCHEMA, header="true")
_through("json", _FLAT, _SELECT, _SCHEMA)
_through("text", "concat(c_custkey, '|', c_name) AS value", "SELECT concat(c_custkey, '|', c_name) AS value FROM customer")
_through("xml", _FLAT, _SELECT, _SCHEMA, rowTag="row")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def scan_partition_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the directory of the wanted key is listed and read."""
    path = out(spark, "pruned")
    table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition("c_nationkey").write.mode("overwrite").partitionBy("c_nationkey").parquet(path)
    return spark.read.parquet(path).where("c_nationkey = 7").select("c_custkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def scan_dynamic_partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broadcast side of the join also prunes the directories of the other."""
    path = out(spark, "dpp")
    table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition("c_nationkey").write.mode("overwrite").partitionBy("c_nationkey").parquet(path)
    nation = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    return spark.read.parquet(path).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name FROM customer")
def scan_merged_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = out(spark, "merged")
    rows = table(spark, sf_dir, "customer")
    rows.where("c_custkey % 2 = 0").select("c_custkey", "c_name").write.mode("overwrite").parquet(f"{path}/p=0")
    rows.where("c_custkey % 2 = 1").select("c_custkey").write.mode("overwrite").parquet(f"{path}/p=1")
    return spark.read.option("mergeSchema", "true").parquet(path).select("c_custkey", "c_name")


@query("SELECT i AS id, i * 2 AS v FROM range(1000) t(i)")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 1000, 1, 8).select("id", (F.col("id") * 2).alias("v"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)")
def scan_local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")


@query("SELECT count(*) AS n, round(sum(p_retailprice), 2) AS s FROM part")
def scan_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").cache()
    return cached.agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("s"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def scan_cached_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CACHE TABLE over a selection, the SQL form of warming a cache."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    name = f"tessera_warm_{crc32(sf_dir.encode()):08x}"  # one cache a folder
    if spark.catalog.tableExists(name):
        spark.sql(f"UNCACHE TABLE {name}")
        spark.catalog.dropTempView(name)
    spark.sql(f"CACHE LAZY TABLE {name} AS SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
    return spark.sql(f"SELECT count(*) AS n FROM {name}")


@query("SELECT count(*) AS n, TRUE AS named FROM nation")
def scan_input_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("_metadata.file_name").alias("f"), F.input_file_name().alias("g"), F.input_file_block_start().alias("b"), F.input_file_block_length().alias("l"))
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.col("g").endswith(F.col("f")) & (F.col("b") >= 0) & (F.col("l") > 0)).alias("named"))


@query("SELECT r_regionkey, r_name FROM region")
def scan_python_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of one's own, read in Arrow batches by partition."""
    import pyarrow.parquet as pq
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self):
            return [InputPartition(0), InputPartition(1)]

        def read(self, partition):
            for k, batch in enumerate(pq.read_table(self.path).to_batches(max_chunksize=2)):
                if k % 2 == partition.value:
                    yield batch

    class Regions(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tessera_regions"

        def schema(self) -> str:
            return "r_regionkey int, r_name string"

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Regions)
    return spark.read.format("tessera_regions").option("path", f"{sf_dir}/region.parquet").load()
