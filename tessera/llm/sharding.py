"""Sharding (operator 6) by vector bin packing of bytes, tokens and rows.

Rows of equal text form a group that stays together. A group goes to the shard whose residual capacity,
as a vector of shares of bytes, tokens and rows, has the highest dot product with the group's. Groups
over 1/HOT_KEYS of the rows or of the bytes (at most 2 * HOT_KEYS, single very long texts among them) are
placed first, on the driver, over all shards; all others are placed in tasks of their own hash range, a
batch at a time with the largest first, so that what a task has placed so far fills the capacity that those
left in proportion, within a small document. Tasks break ties from different shards on.

Tokens are white-space separated words, or the values of a column of token counts, if one is named.

Law: ``bytes`` (sizes near equal), as far as groups that stay whole allow: a group larger than a shard's
share fills its shard alone, up to what the tasks' last documents add. Defined results: a null text counts as empty (size 1); repeated rows are
rows of a group; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import HOT_KEYS, lookup, materialize, ship, texts, tidy

SHARDS = 8
_WORD = r"[^\x20\x09-\x0D]+"
#: Weight of bytes, tokens and rows in the dot product: the law is that of bytes.
WEIGHTS = (8.0, 1.0, 1.0)


def place(items: np.ndarray, capacity: np.ndarray, first: int = 0) -> list[int]:
    """The shard of each item (rows of bytes, tokens, rows), given each shard's capacity in the same units; ties go to shards from ``first`` on."""
    total = np.maximum(capacity.sum(0), 1e-9)
    share, left = items / total, (capacity / total).tolist()
    w = np.array(WEIGHTS)
    shards = [(k + first) % len(left) for k in range(len(left))]
    out = [0] * len(items)
    for k in np.argsort(-share.sum(1), kind="stable").tolist():
        b, t, r = share[k].tolist()
        wb, wt, wr = (share[k] * w).tolist()
        best, at = None, 0
        for s in shards:
            x, y, z = left[s]
            value = (x >= b, wb * x + wt * y + wr * z if x >= b else x)  # where it fits by bytes; else where most are left
            if best is None or value > best:
                best, at = value, s
        out[k] = at
        x, y, z = left[at]
        left[at] = (x - b, y - t, z - r)
    return out


def _placed(batches: Iterator[pa.RecordBatch], free: list[list[float]]) -> Iterator[pa.RecordBatch]:
    """(key, n, shard) of a task's groups, a batch at a time: shards get what is placed so far in proportion to free."""
    task = TaskContext.get()
    first, share = (task.partitionId() if task else 0), np.array(free)
    seen, load = np.zeros(3), np.zeros(share.shape)
    for b in batches:
        if not b.num_rows:
            continue
        items = np.array([c.to_numpy() for c in b.columns[1:4]], float).T
        seen += items.sum(0)
        shard = place(items, share * seen - load, first)
        np.add.at(load, shard, items)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items[:, 2].astype(np.int64)), pa.array(shard, pa.int32())], ["key", "n", "shard"])


def _numbered(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A number within task and shard beside each row (doc_id, size, text_crc32, shard)."""
    task = TaskContext.get().partitionId()
    seen = np.zeros(shards, np.int64)
    for b in batches:
        shard = b.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        count = np.bincount(shard, minlength=shards)
        local = np.empty(len(shard), np.int64)
        local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
        seen += count
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), task)), pa.array(local)], ["doc_id", "size", "text_crc32", "shard", "task", "local"])


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    ship(docs.sparkSession)
    counted = F.regexp_count("text", F.lit(_WORD)) if tokens_col is None else F.coalesce("tokens", F.lit(0))
    source = texts(docs, id_col, text_col, *([F.col(tokens_col).cast("long").alias("tokens")] if tokens_col else []))
    rows = source.select(
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("key"),
        (F.octet_length("text") + 1).cast("long").alias("size"),
        counted.cast("long").alias("tokens"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("key").alias("n")), "shard-groups")
    sums = [float(x or 0) for x in groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("n")).first()]
    hot_bytes, hot_rows = sums[0] / HOT_KEYS, sums[2] / HOT_KEYS
    hot = (F.col("bytes") > hot_bytes) | (F.col("n") > max(1.0, hot_rows))
    large = groups.where(hot).orderBy("key").collect()  # at most 2 * HOT_KEYS rows
    capacity = np.tile(np.maximum(np.array(sums), 1e-9) / shards, (shards, 1))
    fixed = place(np.array([[g.bytes, g.tokens, g.n] for g in large], float).reshape(-1, 3), capacity)
    free = capacity.copy()
    for g, s in zip(large, fixed, strict=True):
        free[s] -= (g.bytes, g.tokens, g.n)
    free = np.maximum(free, 0)
    free = (free / np.maximum(free.sum(0), 1e-9)).tolist()
    where = groups.where(~hot).repartition("key").sortWithinPartitions("key").select("key", "bytes", "tokens", "n").transform(tidy, lambda b: _placed(b, free), "key binary, n long, shard int")
    if large:
        where = where.union(docs.sparkSession.createDataFrame([(g.key, g.n, s) for g, s in zip(large, fixed, strict=True)], "key binary, n long, shard int"))
    where = materialize(where, "shard-groups-placed")
    put = lookup(rows, where, "key", "n", int(sums[2])).select("doc_id", "size", "text_crc32", "shard")
    put = materialize(put.transform(tidy, lambda b: _numbered(b, shards), "doc_id long, size long, text_crc32 long, shard int, task long, local long"), "shard-slots")
    counts = put.groupBy("shard", "task").agg(F.count("shard").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shard-offsets")
    return put.join(offsets, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
