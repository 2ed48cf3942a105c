"""Exact dedup (operator 3) with a log-structured merge index of digests.

Every scan task fills a memtable (digest to best id and members, texts compared byte by byte on a hit)
and flushes it as a sorted run. Runs are shuffled by digest, without texts: a digest that fills a third
of all rows is one entry a run. Each bucket task, of at most about ``BUCKET_ENTRIES`` entries, adds its runs
to an index whose levels carry Bloom filters; a filter hit is confirmed by binary search, and tiers of equal
level are compacted, which keeps the best id and adds up sizes. The digests that an earlier run held when
they were added are the hits: for each, one text a run is picked out where the texts are scanned, and only
those move, to be compared by bytes before the rows are called equal.

Defined results: a null text counts as empty; rows of equal text form a group whatever their other
columns hold; of a group the row with the best (largest or smallest) id stays; rows that repeat an id
and a text are all returned and share a verdict; a null id is never the best unless all are null; an
empty table gives an empty result. Colliding digests are separated by their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialize, maybe_in, python_batches, ship, texts, tidy

#: A memtable is flushed beyond so many rows or characters of distinct text.
MEMTABLE_ROWS, MEMTABLE_CHARS = 20_000, 32_000_000
#: So many runs of one level are compacted into one of the next.
TIER = 4
#: Entries of runs that a bucket's index holds, about: some 100 MB in a worker.
BUCKET_ENTRIES = 1_000_000
#: Bits a digest in a run's filter, and hash functions.
FILTER_BITS, FILTER_HASHES = 10, 4
_RUNS = "digest binary, run long, variant int, best long, members array<long>"


@dataclass(eq=False)
class Run:
    """Sorted digests with best id, number of entries and whether an earlier run held them, and a Bloom filter."""

    digests: np.ndarray
    best: np.ndarray
    rows: np.ndarray
    hit: np.ndarray
    level: int = 0
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.bits = np.zeros(max(64, 1 << int(len(self.digests) * FILTER_BITS).bit_length()), bool)
        for at in self.places(self.digests):
            self.bits[at] = True

    def places(self, digests: np.ndarray) -> list[np.ndarray]:
        words = np.frombuffer(digests.tobytes(), "<u4").reshape(len(digests), digests.itemsize // 4)
        return [(words[:, k % words.shape[1]] * np.uint32(2 * k + 1)) & np.uint32(len(self.bits) - 1) for k in range(FILTER_HASHES)]

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Places of digests in this run, -1 for those that it doesn't hold; the filter spares most searches."""
        out = np.full(len(digests), -1)
        maybe = np.flatnonzero(np.logical_and.reduce([self.bits[p] for p in self.places(digests)]))
        if len(maybe) and len(self.digests):
            at = np.minimum(np.searchsorted(self.digests, digests[maybe]), len(self.digests) - 1)
            hit = self.digests[at] == digests[maybe]
            out[maybe[hit]] = at[hit]
        return out


class LsmIndex:
    """Runs in levels; ids are compared by ``better`` (np.minimum or np.maximum)."""

    def __init__(self, better=np.maximum):
        self.better, self.runs = better, []

    def add(self, digests: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Add a sorted run with a row a digest; returns which of its digests an earlier run holds."""
        hit = self.has(digests)
        self.runs.append(Run(digests, best, np.ones(len(digests), np.int64), hit))
        self.compact()
        return hit

    def has(self, digests: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([r.find(digests) >= 0 for r in self.runs] or [np.zeros(len(digests), bool)])

    def compact(self, full: bool = False) -> None:
        while self.runs:
            last = self.runs[-1].level
            same = [r for r in self.runs if full or r.level == last]
            if len(same) < (2 if full else TIER):
                return
            self.runs = [r for r in self.runs if r not in same] if not full else []
            self.runs.append(self.merged(same, max(r.level for r in same) + 1))

    def merged(self, runs: list[Run], level: int) -> Run:
        digests = np.concatenate([r.digests for r in runs])
        order = np.argsort(digests, kind="stable")
        digests = digests[order]
        first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
        take = lambda k: np.concatenate([getattr(r, k) for r in runs])[order]
        return Run(digests[first], self.better.reduceat(take("best"), first), np.add.reduceat(take("rows"), first), np.logical_or.reduceat(take("hit"), first), level)


def _worst(keep: str) -> int:
    return -(2**63) if keep == "largest" else 2**63 - 1


def flushed(batches: Iterator[pa.RecordBatch], keep: str, digest_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of a scan task's rows."""
    best_of = max if keep == "largest" else min
    worst, task = _worst(keep), TaskContext.get()
    run = (task.partitionId() if task else 0) << 32
    table: dict[bytes, list[list]] = {}
    rows = chars = 0

    def flush() -> pa.RecordBatch:
        entries = [(d, run, k, best_of(m, key=lambda i: worst if i is None else i), m) for d in sorted(table) for k, (_, m) in enumerate(table[d])]
        columns = list(zip(*entries, strict=True))
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "run", "variant", "best", "members"])

    for ids, docs in python_batches(batches):
        for i, text in zip(ids, docs, strict=True):
            raw = text.encode()
            found = table.setdefault(hashlib.sha256(raw).digest()[:digest_bytes], [])
            for known, members in found:
                if known == raw:
                    members.append(i)
                    break
            else:
                found.append([raw, [i]])
                chars += len(raw)
            rows += 1
            if rows >= MEMTABLE_ROWS or chars >= MEMTABLE_CHARS:
                yield flush()
                table, rows, chars, run = {}, 0, 0, run + 1
    if table:
        yield flush()


def compacted(batches: Iterator[pa.RecordBatch], keep: str, digest_bytes: int) -> Iterator[pa.RecordBatch]:
    """The index of a bucket, one row a digest, from entries sorted by run and digest."""
    worst = _worst(keep)
    index = LsmIndex(np.maximum if keep == "largest" else np.minimum)
    kind, held, sizes = f"S{digest_bytes}", [], {}

    def add() -> None:
        if not held:
            return
        digests = np.frombuffer(b"".join(x[0] for x in held), kind)
        index.add(digests, np.array([worst if x[1] is None else x[1] for x in held], np.int64))
        held.clear()

    extra: dict[bytes, tuple] = {}
    last = None
    for b in batches:
        for digest, run, variant, best, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run != last:
                add()
                last = run
            if rows > 1:
                sizes[digest] = sizes.get(digest, 0) + rows - 1
            if variant:
                extra[digest] = (best, rows)
            else:
                held.append((digest, best))
    add()
    index.compact(full=True)
    for r in index.runs:
        raw = [x.ljust(digest_bytes, b"\0") for x in r.digests.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(raw, pa.binary()),
                pa.array([None if x == worst else x for x in r.best.tolist()], pa.int64()),
                pa.array([n + sizes.get(d, 0) for d, n in zip(raw, r.rows.tolist(), strict=True)], pa.int64()),
                pa.array(r.hit),
                pa.array([d in extra for d in raw]),
            ],
            ["digest", "keep_id", "group_size", "hit", "mixed"],
        )


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row per row of docs.

    ``keep`` is 'largest' or 'smallest'; ``digest_bytes`` (a multiple of 4) shortens the SHA-256 digest,
    which only tests of the byte verification have a reason to do.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(keep)
    spark = docs.sparkSession
    ship(spark)
    source = texts(docs, id_col, text_col)
    runs = materialize(source.transform(tidy, lambda b: flushed(b, keep, digest_bytes), _RUNS), "dedup-runs")
    entries = runs.select("digest", "run", "variant", "best", F.size("members").alias("rows"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries.count() // BUCKET_ENTRIES)
    index = materialize(
        entries.repartition(buckets, "digest").sortWithinPartitions("run", "digest").transform(tidy, lambda b: compacted(b, keep, digest_bytes), "digest binary, keep_id long, group_size long, hit boolean, mixed boolean"),
        "dedup-index",
    )
    told = index.agg(F.sum("group_size").alias("n"), F.count_if(F.col("mixed")).alias("mixed"), F.count_if("hit").alias("hits")).first()
    members = runs.select(F.explode("members").alias("doc_id"), "digest")
    verdict = index.select("digest", "keep_id", "group_size")
    if told.hits or told.mixed:
        # One text a run for each hit: equal bytes, or the digest is one of several texts.
        hits = entries.join(index.where("hit").select("digest").hint("shuffle_hash"), "digest", "left_semi").select(F.coalesce("best", F.lit(0)).alias("id0"), "digest")
        kinds = maybe_in(_digested(source, digest_bytes), materialize(hits, "dedup-hits"), ["id0", "digest"]).groupBy("digest", "text").agg(F.lit(1).alias("one"))
        bad = kinds.groupBy("digest").agg(F.count("one").alias("kinds")).where("kinds > 1").select("digest").union(index.where("mixed").select("digest")).distinct()
        bad = materialize(bad, "dedup-collisions")
        if not bad.isEmpty():
            return _separated(source, members, verdict, bad, keep, digest_bytes, told.n)
    out = lookup(members, verdict.where("group_size > 1"), "digest", "group_size", told.n)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "digest")


def _digested(source: DataFrame, digest_bytes: int) -> DataFrame:
    return source.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.substring(F.unhex(F.sha2("text", 256)), 1, digest_bytes).alias("digest"), "text")


def deduplicated(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text: that with the best id, any of those that share it. Only rows of small groups of copies move."""
    found = materialize(exact_dedup(docs, keep, id_col, text_col), "dedup-verdicts")
    groups = found.groupBy("digest").agg(F.first("keep_id").alias("__tessera_keep"), F.count("digest").alias("__tessera_n"), F.count_if("kept").alias("__tessera_k")).where("__tessera_n > 1")
    groups = materialize(groups.withColumnRenamed("digest", "__tessera_key"), "dedup-groups")
    keyed = docs.withColumn("__tessera_key", F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)))
    told = lookup(keyed, groups, "__tessera_key", "__tessera_n", found.count())
    best = F.col(id_col).cast("long").eqNullSafe(F.col("__tessera_keep"))
    out = told.where(F.col("__tessera_n").isNull() | (best & (F.col("__tessera_k") == 1))).select(*docs.columns)
    if groups.where("__tessera_k > 1").isEmpty():
        return out
    return out.unionByName(told.where(best & (F.col("__tessera_k") > 1)).dropDuplicates(["__tessera_key"]).select(*docs.columns))


def _separated(source, members, verdict, bad, keep, digest_bytes, total) -> DataFrame:
    """The result where digests collide: their rows are grouped by digest and text."""
    best = F.max if keep == "largest" else F.min
    full = maybe_in(_digested(source, digest_bytes), bad, "digest").join(bad, "digest", "left_semi")
    groups = full.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("digest").alias("group_size"))
    apart = full.select("doc_id", "digest", "text").join(groups, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
    rest = lookup(members.join(bad, "digest", "left_anti"), verdict.join(bad, "digest", "left_anti"), "digest", "group_size", total)
    both = rest.select("doc_id", "digest", "keep_id", "group_size").union(apart)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
