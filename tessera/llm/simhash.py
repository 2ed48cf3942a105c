"""SimHash near-dedup (operator 10) with pigeonring filtering.

A fingerprint has 64 bits; two link at ``MAX_DIFF`` = 2 or fewer differing bits. The bits form a ring of
three thirds. If the whole ring differs in at most 2 bits there is a third from which every chain of
consecutive thirds stays within its share of the budget (floor of 2/3, 4/3 and 2): that third is equal,
it and the next differ in at most 1 bit, so a half of that next third is equal too. Each distinct
fingerprint is thus filed under six keys of about 32 equal bits; only pairs under one key whose chains
stay within the shares come to the full Hamming check. Keys that hold over ``BUCKET`` fingerprints are
refined by pigeonhole on the bits left, at last to a size bounded by the bits.

Equal fingerprints are one class from the start, so copies are never compared; links join class
representatives and components are found by rounds of stars in Spark.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle; repeated rows and ids are returned each; a null id is never the smallest
unless all ids of a component are null, which then is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, lookup, materialize, python_batches, ship, texts, tidy

SHINGLE, SEED, MAX_DIFF = 3, 42, 2
#: Fingerprints under one key that are compared with each other; larger groups are refined.
BUCKET = 4_096
#: Shingles of a text whose bits are counted at once.
_AT_ONCE = 1 << 16
_ALL = 2**64 - 1


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


#: Thirds of the ring, and the halves of each.
THIRDS = [_mask(0, 21), _mask(21, 42), _mask(42, 64)]
HALVES = [[_mask(0, 10), _mask(10, 21)], [_mask(21, 31), _mask(31, 42)], [_mask(42, 53), _mask(53, 64)]]
#: The six keys: a third, and half of the third that follows it.
KEYS = [THIRDS[i] | h for i in range(3) for h in HALVES[(i + 1) % 3]]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def refined(mask: int) -> list[int]:
    """Masks with a third more of the bits left: of at most 2 differing bits one third has none."""
    rest = [k for k in range(64) if not mask >> k & 1]
    cut = [rest[len(rest) * k // 3 : len(rest) * (k + 1) // 3] for k in range(3)]
    return [mask | sum(1 << b for b in part) for part in cut]


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()  # bytes: lowers A-Z only and splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: -SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), _AT_ONCE):
        part = h[lo : lo + _AT_ONCE]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in python_batches(batches):
            fps = np.array([fingerprint(t) for t in part], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).transform(tidy, run, "doc_id long, fp long")


def _ring(x: np.ndarray) -> np.ndarray:
    """Whether differing bits pass the pigeonring filter and the full check."""
    d = [np.bitwise_count(x & np.uint64(t)) for t in THIRDS]
    pass_ = np.zeros(len(x), bool)
    for i in range(3):
        chain = d[i] + d[(i + 1) % 3]
        pass_ |= (d[i] <= MAX_DIFF // 3) & (chain <= 2 * MAX_DIFF // 3)
    out = np.zeros(len(x), bool)
    at = np.flatnonzero(pass_)
    out[at] = np.bitwise_count(x[at]) <= MAX_DIFF
    return out


def group_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the components of one group of distinct fingerprints: a tree of each, rows in blocks."""
    n = len(fps)
    root = np.full(n, -1)
    for k in range(n):
        if root[k] >= 0:
            continue
        root[k], front = k, np.array([k])
        while len(front):
            open_ = np.flatnonzero(root < 0)
            if not len(open_):
                break
            hit = np.zeros(len(open_), bool)
            for f in fps[front]:
                todo = np.flatnonzero(~hit)
                hit[todo] = _ring(fps[open_[todo]] ^ f)
            front = open_[hit]
            root[front] = k
    child = np.flatnonzero(root != np.arange(n))
    return fps[root[child]], fps[child]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within keys, of rows (mask, value, fp) sorted by key."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def links(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mask, value, fp = cols
        first = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        size = np.diff(np.r_[first, len(fp)])
        u = fp.view(np.uint64)
        found = []
        two = first[size == 2]
        ok = _ring(u[two] ^ u[two + 1])
        found.append((u[two[ok]], u[two[ok] + 1]))
        for lo, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found.append(group_links(u[lo : lo + n]))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if at:
            yield from links([c[:at] for c in cols])
        rest = [c[at:] for c in cols]
    if len(rest[0]):
        yield from links(rest)


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for m in masks])
    return fps.select(F.explode(keys).alias("k"), "fp").select("k.mask", "k.value", "fp")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect exactly those within MAX_DIFF bits."""
    ship(fps.sparkSession)
    masks, out = KEYS, None
    keyed = _keyed(fps, masks)
    for level in count():
        hot = keyed.groupBy("mask", "value").count().where(F.col("count") > bucket).select("mask", "value") if level < 3 else None
        if hot is not None:
            hot = materialize(hot, f"simhash-hot-{level}")
            if hot.isEmpty():
                hot = None
        cold = keyed
        if hot is not None:
            cold = keyed.join(hot, ["mask", "value"], "left_anti")  # the engine broadcasts by bytes, or shuffles
        found = cold.repartition("mask", "value").sortWithinPartitions("mask", "value").transform(tidy, _links, "a long, b long")
        out = found if out is None else out.union(found)
        if hot is None:
            return out
        finer = {m: refined(m) for m in masks}
        part = keyed.join(hot, ["mask", "value"], "left_semi")
        keyed = None
        for m, children in finer.items():
            more = _keyed(part.where(F.col("mask") == signed(m)).select("fp"), children)
            keyed = more if keyed is None else keyed.union(more)
        keyed = materialize(keyed.distinct(), f"simhash-fine-{level}")
        masks = sorted({c for x in finer.values() for c in x})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the smallest doc_id reachable by links."""
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("fp").alias("rows")), "simhash-classes")
    total = classes.agg(F.sum("rows").alias("n"), F.count("fp").alias("classes")).first()
    parts = components(links(classes.select("fp")), "simhash-cc")
    labels = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "rows", F.coalesce("component", "fp").alias("label"))
    labels = materialize(labels, "simhash-labels")
    low = labels.groupBy("label").agg(F.min("first").alias("least"), F.count("label").alias("size")).where("size > 1")
    named = lookup(labels, low, "label", "size", total.classes).select("fp", "rows", "first", F.when(F.col("size").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    named = materialize(named.where("rows > 1 or not component_id <=> first").select("fp", "rows", "component_id"), "simhash-named")
    component = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return lookup(fps, named, "fp", "rows", total.n).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
