"""Near-duplicates by SimHash fingerprints, and by exact Jaccard similarity of word shingles.

``deduplicated`` (the pipeline's stage) links rows whose SimHash fingerprints differ in at most 2 of 64 bits, found
by pigeonring filtering as in operator 10 (``simhash``). Texts at a similarity of 0.8 differ in more bits than
any keys of a fingerprint could be searched by, so for the rest of the job the sets themselves are compared, with candidates by
MinHash bands; ``near_duplicates`` gives these links alone. Components are those of both kinds of links together.

Texts with equal shingle sets are one class from the start. A class is filed under ``BANDS`` keys of ``ROWS``
minima; at similarity 0.8 a pair shares no key in 5e-8 of cases. Each group under a key first has its members
checked against its smallest one; then members that are still in different components are checked with each
other, so a group of copies costs a check a member and no pair of unconnected members goes unseen. A sketch of
one byte a minimum spares the check of pairs far below the threshold; a pair at 0.8 fails it in about 1e-8 of cases.

Words are those of simhash. Null and empty texts have no shingle and equal only each other; fewer words
than a shingle make one shingle; a null id is never the smallest unless all ids of a component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import components, kept_rows, lookup, materialize, maybe_in, python_batches, ship, texts, tidy

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, SKETCH = 32, 4, 128
#: Standard deviations by which a sketch may fall short of the threshold.
SLACK = 6
_AT_ONCE = 1 << 9
#: Characters of texts that are cut into shingles at once.
_CHARS = 1 << 20
_random = np.random.default_rng(42)
_A = _random.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, BANDS * ROWS, np.uint64)


def _mixed(words: np.ndarray, n: int, shingle: int) -> np.ndarray:
    """Hashes of all ``shingle`` words in a row, of the hashes of ``n`` more words than windows."""
    x = np.zeros(n, np.uint64)
    for j, c in enumerate(np.random.default_rng(shingle).integers(0, 2**63, shingle, np.uint64)):
        x += words[j : j + n] * (c * np.uint64(2) + np.uint64(1))
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def shingles(part: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; each distinct word is hashed once."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(part, pa.large_string())))
    named = cut.flatten().dictionary_encode()
    at, names = named.indices.to_numpy(), named.dictionary.to_pylist()
    real = np.array([w != "" for w in names], bool)[at]
    words = np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64)[at[real]]
    ends = np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(cut.value_lengths().to_numpy())]].tolist()
    all_ = _mixed(words, max(0, len(words) - shingle + 1), shingle)
    return [_distinct(all_[lo : hi - shingle + 1]) if hi - lo >= shingle else _mixed(words[lo:hi], min(1, hi - lo), hi - lo) for lo, hi in pairwise(ends)]


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)  # here several times as fast as np.unique
    return h[np.r_[True, h[1:] != h[:-1]]]


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for lo in range(0, len(h), _AT_ONCE):
        x = h[lo : lo + _AT_ONCE, None] * _A
        x += _B
        out = np.minimum(out, (x.min(0) >> np.uint64(32)).astype(np.uint32))
    return out


def _keys(m: np.ndarray) -> np.ndarray:
    k = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(m), BANDS))
    for j in range(ROWS):
        k = (k ^ m[:, j::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        k = (k ^ k >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        k = k ^ k >> np.uint64(32)
    return k


def _sketched(batches: Iterator[pa.RecordBatch], shingle: int, prints: bool) -> Iterator[pa.RecordBatch]:
    for ids, part in python_batches(batches, _CHARS):
        sets = shingles(part, shingle)
        m = np.stack([minima(h) for h in sets])
        key = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        tag = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in part], np.uint64).view(np.int64)
        keys = pa.FixedSizeListArray.from_arrays(pa.array(_keys(m).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        sketch = [r.tobytes() for r in m[:, :SKETCH].astype(np.uint8)]
        fps = pa.array(np.array([simhash.fingerprint(t) for t in part], np.uint64).view(np.int64)) if prints else pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tag), pa.array(key), pa.array([len(h) for h in sets], pa.int64()), keys, pa.array(sketch, pa.binary()), fps], ["doc_id", "tag", "set", "n", "keys", "sketch", "fp"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each group of at least two rows of equal first column, of sorted rows."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = np.r_[np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]), len(cols[0])]
        for lo, hi in zip(cut[:-2].tolist(), cut[1:-1].tolist(), strict=True):
            if hi - lo > 1:
                yield [c[lo:hi] for c in cols]
        rest = [c[cut[-2] :] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []
    for g in _groups(batches):
        held.append(g)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["key", "set"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["key", "set"])


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): of rows (key, set, label, n, sketch) pairs of different labels that may be similar.

    Without labels (all null, read as NaN) only pairs with a group's first member.
    """
    p = percent / 100
    least = SKETCH * p - SLACK * (SKETCH * p * (1 - p)) ** 0.5
    held: list = []
    size = 0
    for _, set_, label, n, sketch in _groups(batches):
        n = n.astype(np.int64)
        sk = np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, SKETCH)
        if label.dtype.kind == "f":
            todo, label = [0], np.arange(len(set_))
        else:
            names, at = np.unique(label, return_inverse=True)
            todo = np.flatnonzero(at != np.bincount(at).argmax()).tolist() if len(names) > 1 else []
        done = np.zeros(len(set_), bool)
        for k in todo:
            done[k] = True
            with_ = np.flatnonzero((label != label[k]) & ~done & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])))
            with_ = with_[(sk[with_] == sk[k]).sum(1) >= least]
            if len(with_):
                held.append((np.minimum(set_[with_], set_[k]), np.maximum(set_[with_], set_[k])))
                size += len(with_)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["a", "b"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["a", "b"])


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, hashes_a, hashes_b) whose sets are similar."""
    shared, both = F.size(F.array_intersect("hashes_a", "hashes_b")), F.size("hashes_a") + F.size("hashes_b")
    return pairs.where(100 * shared >= percent * (both - shared)).select("a", "b")


def _beside(pairs: DataFrame, sets: DataFrame, side: str, total: int) -> DataFrame:
    """pairs with the shingles of one side; the at most 1000 sides in over 1/1000 of the pairs are broadcast."""
    named = sets.select(F.col("set").alias(side), F.col("hashes").alias(f"hashes_{side}"))
    hot = pairs.groupBy(side).count().where(F.col("count") > max(1_000, total // 1_000)).select(side)
    far = pairs.join(F.broadcast(hot), side, "left_anti").join(named.hint("shuffle_hash"), side)
    near = pairs.join(F.broadcast(named.join(F.broadcast(hot), side)), side)
    return far.unionByName(near)


def _by_prints(rows: DataFrame, total: int) -> DataFrame:
    """(a, b): sets linked by equal fingerprints ``fp`` of rows, or by ones that simhash links."""
    least = rows.groupBy("fp").agg(F.min("set").alias("least"), F.max("set").alias("most"), F.count("fp").alias("rows"))
    least = materialize(least, "near-prints")
    equal = lookup(rows.select("fp", "set"), least.where("least <> most").select("fp", "least", "rows"), "fp", "rows", total).where("least <> set").select(F.col("least").alias("a"), F.col("set").alias("b"))
    found = materialize(simhash.links(least.select("fp")), "near-simhash")
    of = least.select("fp", "least").hint("shuffle_hash")
    beside = found.join(of.toDF("a", "set_a"), "a").join(of.toDF("b", "set_b"), "b")
    return materialize(equal.union(beside.where("set_a <> set_b").select("set_a", "set_b")).distinct(), "near-by-prints")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable by links of at least ``percent`` similarity."""
    return _told(docs, shingle, percent, False, id_col, text_col).select("doc_id", F.col("best.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of links by fingerprint or by similarity: that with the smallest doc_id (any other before a null one), of equal ids that with the smallest hash."""
    told = _told(docs, shingle, percent, True, id_col, text_col)
    verdicts = told.select("doc_id", "tag", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tag") == F.col("best.tag"))).alias("kept"))
    return kept_rows(docs, verdicts, F.xxhash64, id_col, text_col)


def _told(docs: DataFrame, shingle: int, percent: int, prints: bool, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, best): the hash of the text, and the first row of its component by id (null ids last) and hash.

    ``prints``: links by fingerprint count besides those by similarity.
    """
    ship(docs.sparkSession)
    source = texts(docs, id_col, text_col)
    rows = materialize(source.transform(tidy, lambda b: _sketched(b, shingle, prints), "doc_id long, tag long, set long, n long, keys array<long>, sketch binary, fp long"), "near-rows")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    one = rows.groupBy("set").agg(F.min(who).alias("first"), F.count("set").alias("rows"), F.min("tag").alias("tag"))
    one = materialize(one, "near-sets")
    total = one.agg(F.sum("rows").alias("n"), F.count("set").alias("sets")).first()
    banded = rows.where("n > 0").select(F.explode("keys").alias("key"), "set")
    held = banded.distinct() if (total.n or 0) > total.sets else banded
    members = materialize(held.repartition("key").sortWithinPartitions("key", "set").transform(tidy, _members, "key long, set long"), "near-members")
    used = materialize(members.select("set").distinct().join(one.select("set", "tag").hint("shuffle_hash"), "set"), "near-used")
    about = materialize(rows.select("set", "n", "sketch").dropDuplicates(["set"]).join(used.select("set").hint("shuffle_hash"), "set", "left_semi"), "near-about")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, part in python_batches(batches, _CHARS):
            found = shingles(part, shingle)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), hashes], ["set", "hashes"])

    tagged = maybe_in(source.select(F.xxhash64("text").alias("tag"), "text"), used, "tag").join(used.hint("shuffle_hash"), "tag").select("set", "text")
    sets = materialize(tagged.transform(tidy, hashed, "set long, hashes array<long>").dropDuplicates(["set"]), "near-hashes")

    def links(labels: DataFrame | None, name: str) -> DataFrame:
        marked = about.withColumn("label", F.lit(None).cast("long")) if labels is None else about.join(labels, about["set"] == labels["node"], "left").select(*about.columns, F.coalesce("component", "set").alias("label"))
        wide = members.join(marked.hint("shuffle_hash"), "set").select("key", "set", "label", "n", "sketch")
        pairs = wide.repartition("key").sortWithinPartitions("key", "set").transform(tidy, lambda b: _pairs(b, percent), "a long, b long").distinct()
        pairs = materialize(pairs, f"near-pairs-{name}")
        n = pairs.count()
        both = _beside(_beside(pairs, sets, "a", n), sets, "b", n).select("a", "b", "hashes_a", "hashes_b")
        return materialize(_similar(both, percent), f"near-links-{name}")

    first = links(None, "star")
    if prints:
        first = first.union(_by_prints(rows, total.n))
    parts = components(first, "near-cc-star")
    more = links(parts, "rest")
    if not more.isEmpty():
        parts = components(first.union(more), "near-cc")
    labels = one.join(parts.withColumnRenamed("node", "set"), "set", "left").select("set", "first", "rows", F.coalesce("component", "set").alias("label"))
    labels = materialize(labels, "near-labels")
    low = labels.groupBy("label").agg(F.min("first").alias("best"), F.count("label").alias("size")).where("size > 1")
    named = lookup(labels, low, "label", "size", total.sets).select("set", "rows", "first", F.coalesce("best", "first").alias("best"))
    named = materialize(named.where("rows > 1 or best <> first").select("set", "rows", "best"), "near-named")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    return lookup(rows.select("doc_id", "tag", "set"), named, "set", "rows", total.n).select("doc_id", "tag", F.coalesce("best", own).alias("best"))
