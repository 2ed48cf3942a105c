"""Shared pieces of the training-data operators: scratch tables, skew-proof lookups, components.

Nothing here collects per-document data to the driver, and no plan depends on the size of a table. The only
things broadcast are bounded by construction: at most ``HOT_KEYS`` keys, and a filter of ``FILTER_SLOTS`` rows.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds over 1/HOT_KEYS of all rows; there are at most HOT_KEYS such keys.
HOT_KEYS = 10_000
#: Rows of a key filter, of 16 longs each: 2^27 bits, about 20 MB, however many keys it stands for.
FILTER_SLOTS = 1 << 17
#: Arrow batches given to Python are cut so that a worker's memory stays bounded.
ROWS_PER_BATCH = 2_000
_HELD: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, as in tests) one made here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = Path(tempfile.gettempdir(), "tessera-shared").as_uri()
        os.makedirs(at.removeprefix("file://"), exist_ok=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    held = tempfile.TemporaryDirectory(prefix="tessera-code-")  # the driver serves the file as long as it runs
    to = Path(held.name, f"{root.name}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _HELD.append(held)
    sc._tessera_shipped = True


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id long, text string, more): only what the operators need, so clashing extra columns never matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and their peak would stay with them."""
    try:
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow(work, schema), whose workers give back what a task held when it is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return df.mapInArrow(run, schema)


def python_batches(batches: Iterator[pa.RecordBatch], max_chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(ids, texts) lists of bounded size; a text longer than the bound comes alone."""
    ids: list = []
    out: list = []
    held = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS_PER_BATCH):
            part = batch.slice(lo, ROWS_PER_BATCH)
            for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                t = t.as_py()
                if held and held + len(t) > max_chars:
                    yield ids, out
                    ids, out, held = [], [], 0
                ids.append(i)
                out.append(t)
                held += len(t)
    if ids:
        yield ids, out


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _slot(keys: list[str]) -> tuple[Column, Column, Column]:
    """Row, long and bit of a key in a filter."""
    h = F.xxhash64(*keys)
    return h.bitwiseAND(F.lit(FILTER_SLOTS - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(15)).cast("int"), F.shiftrightunsigned(h, 50).bitwiseAND(F.lit(63)).cast("int")


def key_filter(keys: DataFrame, on: list[str]) -> DataFrame:
    """(_slot, _words): a bit map of hashed keys with at most FILTER_SLOTS rows; built with partial aggregates.

    It lets every key pass, and others as it fills up: about 1 in 100 beside a million keys, 1 in 10 beside
    fourteen million. What passes in vain costs a shuffle and no more.
    """
    slot, word, bit = _slot(on)
    told = keys.select(slot.alias("__tessera_slot"), word.alias("_w"), bit.alias("_b"))
    words = [F.bit_or(F.when(F.col("_w") == k, F.expr("shiftleft(1L, _b)")).otherwise(F.lit(0).cast("long"))).alias(f"_{k}") for k in range(16)]
    return told.groupBy("__tessera_slot").agg(*words).select("__tessera_slot", F.array(*[f"_{k}" for k in range(16)]).alias("__tessera_words"))


def lookup(rows: DataFrame, index: DataFrame, keys: str | list[str], size: str, total: int) -> DataFrame:
    """rows left-joined with index (one row per key): one plan at all sizes, where a key may hold a third of all rows.

    ``size`` is the column of index with the key's number of rows. Keys over total / HOT_KEYS are at most
    HOT_KEYS in number: those index rows are broadcast and their rows never move. Nor do rows whose key the
    filter of the other keys holds back. Only what passes is joined by shuffle, in groups of bounded size.
    """
    keys = [keys] if isinstance(keys, str) else keys
    bound = max(1, (total or 0) // HOT_KEYS)
    others = [c for c in index.columns if c not in keys]
    hot, cold = index.where(F.col(size) > bound), index.where(F.col(size) <= bound)
    marked = _passing(rows, cold, keys).join(F.broadcast(hot.withColumn("__tessera_hot", F.lit(True))), keys, "left")
    near = marked.where("__tessera_hot or not __tessera_maybe").select(*rows.columns, *others)
    far = marked.where("__tessera_hot is null and __tessera_maybe").select(*rows.columns).join(cold.hint("shuffle_hash"), keys, "left").select(*rows.columns, *others)
    return near.unionByName(far)


def _passing(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """rows and whether (``_maybe``) their key may be in index."""
    slot, word, bit = _slot(keys)
    beside = rows.withColumn("__tessera_at", slot).join(F.broadcast(key_filter(index, keys).withColumnRenamed("__tessera_slot", "__tessera_at")), "__tessera_at", "left")
    found = F.getbit(F.get("__tessera_words", word), bit) == 1
    return beside.select(*rows.columns, F.coalesce(found, F.lit(False)).alias("__tessera_maybe"))


def maybe_in(rows: DataFrame, index: DataFrame, keys: str | list[str]) -> DataFrame:
    """The rows whose key is in index, and some whose key isn't; nothing is shuffled."""
    return _passing(rows, index, [keys] if isinstance(keys, str) else keys).where("__tessera_maybe").select(*rows.columns)


def kept_rows(docs: DataFrame, verdicts: DataFrame, tag, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that verdicts (doc_id, tag, kept; one row per row of docs) don't keep.

    Rows are told by id and tag, null-safe, where ``tag(text column)`` is the same as verdicts' tag. Of kept
    rows that agree in both one stays. Only rows to be dropped, or kept once, can move.
    """
    verdicts = materialize(verdicts.select("doc_id", "tag", "kept"), "kept-verdicts")
    named = verdicts.select(F.col("doc_id").isNull().alias("__tessera_null"), F.coalesce("doc_id", F.lit(0)).alias("__tessera_id"), F.col("tag").alias("__tessera_tag"), "kept")
    index = named.groupBy("__tessera_null", "__tessera_id", "__tessera_tag").agg(F.count("__tessera_id").alias("__tessera_n"), F.bool_or("kept").alias("__tessera_once")).where("__tessera_n > 1 or not __tessera_once")
    index = materialize(index, "kept-index")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select("*", F.col(id_col).isNull().alias("__tessera_null"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__tessera_id"), tag(text).alias("__tessera_tag"))
    told = lookup(keyed, index, ["__tessera_null", "__tessera_id", "__tessera_tag"], "__tessera_n", verdicts.count())
    rest = told.where("__tessera_once is null").select(*docs.columns)
    if index.where("__tessera_once").isEmpty():
        return rest
    return rest.unionByName(told.where("__tessera_once").dropDuplicates(["__tessera_null", "__tessera_id", "__tessera_tag"]).select(*docs.columns))


def _content(edges: DataFrame):
    """Number and order-free digest of edges, to tell whether a round changed them."""
    return edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()


def _beside_low(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m of low (u, m, _n); the edges of a centre that holds over 1/HOT_KEYS of all don't move."""
    bound = max(1_000, total // HOT_KEYS)
    hot = F.broadcast(low.where(F.col("_n") > bound))
    far = edges.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("_n") <= bound), "u")
    return far.select("u", "v", "m").union(edges.join(hot, "u").select("u", "v", "m"))


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b long).

    Alternating large-star and small-star rounds: all shuffles carry edges only, groups are reduced by
    min before they move, and the lineage is cut in the shared folder after each round.
    """
    und = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialize(und, f"{name}-0")
    now = _content(cur)
    for k in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("v").alias("_n"))
        large = _beside_low(both.where("v > u"), low, now[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), f"{name}-{k + 1}-large")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("_n"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small_ = _beside_low(large, low2, now[0]).select(F.explode(pairs).alias("e")).select("e.*")
        new = materialize(small_.where("u != v").distinct(), f"{name}-{k + 1}")
        cur, before, now = new, now, _content(new)
        if now == before:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
