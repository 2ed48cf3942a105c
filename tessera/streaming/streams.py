"""Streams: Structured Streaming over a replayed table, run to its end and read from a table sink.

``replay`` turns a table into a file stream. ``drain`` runs a query with available-now triggers into a
folder, with its checkpoint beside it, and reads the folder back.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query, table
from tessera.sources.sinks import out


def replay(spark: SparkSession, sf_dir: str, name: str = "events", per_trigger: int = 1) -> DataFrame:
    """A table as a stream of files, each a range of time."""
    path = out(spark, f"replay-{name}")
    rows = table(spark, sf_dir, name).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(2, "ts").sortWithinPartitions("ts").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    path, check = out(spark, f"stream-{name}"), out(spark, f"check-{name}")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def replace(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = stream.writeStream.foreachBatch(replace).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT event_id, user_id, round(value * 0.908, 6) AS value FROM events WHERE event_type <> 'view'")
def stream_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replay(spark, sf_dir).where("event_type <> 'view'").select("event_id", "user_id", F.round(F.col("value") * 0.908, 6).alias("value"))
    return drain(s, "calc")


@query("SELECT event_id FROM events WHERE event_id % 123 = 0")
def stream_filter_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(replay(spark, sf_dir).where("event_id % 123 = 0").select("event_id"), "mod")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS a FROM events GROUP BY event_type")
def stream_group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(replay(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("a")), "group", "complete")


#: Seconds of the newest row less the hour that a watermark waits: windows that end later are never emitted.
_MARK = "(SELECT epoch(max(ts)) - 3600 FROM events)"


@query(f"SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING start + 3600 <= {_MARK}")
def stream_window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are emitted once, when the watermark passes their end; those still open aren't."""
    s = replay(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return drain(s.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n"), "tumble")


@query(f"SELECT (CAST(floor(epoch(ts)) AS BIGINT) // 1800 - i) * 1800 AS start, count(*) AS n FROM events, range(2) t(i) GROUP BY 1 HAVING start + 3600 <= {_MARK}")
def stream_window_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replay(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return drain(s.select(F.unix_timestamp("window.start").alias("start"), "n"), "hop")


@query("SELECT (CAST(floor(epoch(ts)) AS BIGINT) // 3600) * 3600 + 1200 * (i + 1) AS upto, count(*) AS n FROM events, range(3) t(i) WHERE CAST(floor(epoch(ts)) AS BIGINT) % 3600 < 1200 * (i + 1) GROUP BY 1")
def stream_window_cumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that grow by 20 minutes up to an hour."""
    s = replay(spark, sf_dir).select(F.unix_timestamp("ts").alias("t"))
    s = s.select((F.col("t") - F.col("t") % 3600).alias("h"), F.explode(F.expr("filter(array(1200, 2400, 3600), x -> t % 3600 < x)")).alias("x"))
    return drain(s.groupBy((F.col("h") + F.col("x")).alias("upto")).agg(F.count("*").alias("n")), "cumulate", "complete")


@query("""SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id,
    CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s HAVING max(epoch(ts)) + 1800 <= """ + _MARK)  # fmt: skip
def stream_window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = replay(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return drain(s.select("user_id", "n"), "session")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row number 1 of a key: later rows of the key are dropped."""
    return drain(replay(spark, sf_dir).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "first")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined on a key and a bounded time, so state can be dropped."""
    s = replay(spark, sf_dir)
    a = s.where("event_type = 'click'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").alias("ta")).withWatermark("ta", "1 hour")
    b = replay(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb")).withWatermark("tb", "1 hour")
    return drain(a.join(b, F.expr("ua = ub AND tb BETWEEN ta AND ta + INTERVAL 10 MINUTES")).select("a", "b"), "interval")


_CLICKS = "SELECT event_id AS a, user_id AS ua, ts AS ta FROM events WHERE event_type = 'click'"
_BUYS = "SELECT event_id AS b, user_id AS ub, ts AS tb FROM events WHERE event_type = 'purchase'"


def _clicks_and_buys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = replay(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").alias("ta"))
    b = replay(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb"))
    return a.withWatermark("ta", "1 hour"), b.withWatermark("tb", "1 hour")


@query(f"""SELECT a, b FROM ({_CLICKS}) a LEFT JOIN ({_BUYS}) b ON ua = ub AND tb BETWEEN ta AND ta + INTERVAL 10 MINUTE
    WHERE b IS NOT NULL OR epoch(ta) + 600 < (SELECT least(max(epoch(ta)), (SELECT max(epoch(tb)) FROM ({_BUYS}) y)) - 3600 FROM ({_CLICKS}) x)""")  # fmt: skip
def stream_join_interval_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a partner is emitted when the watermark of both streams rules one out."""
    a, b = _clicks_and_buys(spark, sf_dir)
    return drain(a.join(b, F.expr("ua = ub AND tb BETWEEN ta AND ta + INTERVAL 10 MINUTES"), "left").select("a", "b"), "outer")


@query(f"SELECT a, b FROM ({_CLICKS}) a JOIN ({_BUYS}) b ON ua = ub AND CAST(floor(epoch(ta)) AS BIGINT) // 3600 = CAST(floor(epoch(tb)) AS BIGINT) // 3600")
def stream_join_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined on equal windows."""
    a, b = _clicks_and_buys(spark, sf_dir)
    a, b = a.withColumn("wa", F.window("ta", "1 hour")), b.withColumn("wb", F.window("tb", "1 hour"))
    return drain(a.join(b, F.expr("ua = ub AND wa = wb")).select("a", "b"), "same-window")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def stream_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent keys so far, replaced with every batch."""
    s = replay(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    return drain(s, "top", "complete")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey < 10")
def stream_join_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey", "c_name")
    return drain(replay(spark, sf_dir).join(side, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"), "static")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_stateful_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals in state of one's own; the last one of a key is its result."""

    def add(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    s = replay(spark, sf_dir).select("user_id", "value").groupBy("user_id").applyInPandasWithState(add, "user_id long, n long, total double", "n long, total double", "append", "NoTimeout")
    got = drain(s, "stateful")
    return got.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("SELECT count(*) AS n FROM events")
def stream_source_rate_and_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory sink that is read as a table.

    The driver holds all that such a sink gets, so rows are counted in the stream and each batch replaces the count.
    """
    name = "tessera_memory"
    s = replay(spark, sf_dir, per_trigger=2).groupBy().agg(F.count("*").alias("n"))
    q = s.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query("SELECT i AS value, i % 7 AS k FROM range(100) t(i)")
def stream_source_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of the rate source that counts by batch."""
    path, check = out(spark, "stream-rate"), out(spark, "check-rate")
    s = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 100).load().select("value", (F.col("value") % 7).alias("k"))
    q = s.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).trigger(once=True).start()
    q.awaitTermination()
    return spark.read.schema(s.schema).parquet(path)


_MIDDLE = "(SELECT (epoch(min(ts)) + epoch(max(ts))) / 2 FROM events)"


@query(f"SELECT CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start, count(*) AS n FROM events WHERE epoch(ts) >= {_MIDDLE} GROUP BY 1 HAVING start + 3600 <= {_MARK}")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer half of the rows comes first, in two batches: when the older half arrives the watermark has passed it, and it is dropped.

    A batch is held to the watermark that the one before it started with, hence two.
    """
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = rows.select(F.min("ts").cast("double").alias("lo"), F.max("ts").cast("double").alias("hi")).first()
    newer = F.col("ts").cast("double") >= (ends.lo + ends.hi) / 2
    path = out(spark, "replay-late")
    for part in (rows.where(newer & (F.col("event_id") % 2 == 0)), rows.where(newer & (F.col("event_id") % 2 == 1)), rows.where(~newer)):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    s = s.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return drain(s.select(F.unix_timestamp("window.start").alias("start"), "n"), "late")
