"""Best-fit packing of token sequences (operator 8) with swap-based local search.

Texts are encoded where they are read; only (id, piece, start, length, checksum) rows move on. Blocks of
pieces are packed by best fit in descending order; then local search takes the emptiest bins one after another
and moves their pieces, or exchanges one for one or two for one with fuller bins, as long as the sum of
squared fills grows, until a bin is empty; one that can't be emptied is left for the next donor. Bins that stay open are unpacked into the next block of the task, and
those left at a task's end are packed once more together, so blocks cost next to nothing.

Defined results: a null or empty text is one piece that holds only the end token; a text longer than the
capacity is cut into full pieces and a rest; repeated rows and null ids are packed like any others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import encoded
from tessera.llm.common import materialize, ship, texts, tidy

CAPACITY, END_ID = 4096, 1
#: Pieces packed at once in a task.
BLOCK = 40_000
#: A bin is open if it is filled to less than this share; at most so many are carried to the next block.
OPEN_BELOW, CARRIED = 0.995, 2_000
#: Underfull bins tried as donors in a pass, and takers looked at in one search.
DONORS, VISITS = 64, 400_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, open boolean"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and the end token, cut only beyond the capacity."""
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raw in encoded(path, batches):
            rows = []
            for i, ids_raw in zip(ids, raw, strict=True):
                ids_raw += end
                for k, lo in enumerate(range(0, len(ids_raw), step)):
                    part = ids_raw[lo : lo + step]
                    rows.append((i, k, lo // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).transform(tidy, run, _PIECE)


class Bins:
    """Bins of item numbers; lengths are looked up in ``size``."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity, self.items, self.gap = size, capacity, [], []

    def best_fit(self) -> None:
        """Longest first, each into the open bin that it fills best."""
        by_gap: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        some = 0  # bit g is set if a bin has gap g
        for k in sorted(range(len(self.size)), key=self.size.__getitem__, reverse=True):
            n = self.size[k]
            if up := some >> n:
                g = n + (up & -up).bit_length() - 1
                b = by_gap[g].pop()
                if not by_gap[g]:
                    some ^= 1 << g
                self.items[b].append(k)
                self.gap[b] = g = g - n
            else:
                b, g = len(self.items), self.capacity - n
                self.items.append([k])
                self.gap.append(g)
            if g:
                by_gap[g].append(b)
                some |= 1 << g

    def fewest(self) -> int:
        return -(-sum(self.size) // self.capacity)

    def search(self) -> None:
        """Empty underfull bins, the emptiest first; one that can't be emptied is passed over, and all are tried again after a success.

        Pieces that fill others better have moved even where a donor was not emptied, so a later pass may
        empty what an earlier one couldn't. The number of takers looked at is bounded by ``VISITS``.
        """
        alive, least, budget = sum(1 for x in self.items if x), self.fewest(), VISITS
        while alive > least and budget > 0:
            order = sorted((b for b in range(len(self.items)) if self.gap[b] and self.items[b]), key=self.gap.__getitem__, reverse=True)
            emptied = 0
            for donor in order[:DONORS]:
                takers = [b for b in order if b != donor and self.items[b] and self.gap[b]]
                if sum(self.gap[t] for t in takers) < self.capacity - self.gap[donor]:
                    break  # fuller donors can't be emptied either
                while self.items[donor] and budget > 0:
                    budget -= len(takers)
                    if not self.improve(donor, takers):
                        break
                if not self.items[donor]:
                    emptied += 1
                    alive -= 1
                    if alive <= least:
                        return
            if not emptied:
                return

    def improve(self, donor: int, takers: list[int]) -> bool:
        """One pass of moves and exchanges that fill takers from the donor; whether any was made."""
        size, done = self.size, False
        mine = sorted((size[k], k) for k in self.items[donor])
        for t in takers:
            g = self.gap[t]
            if not g or not mine:
                continue
            at = bisect_right(mine, (g, len(size)))
            if at and mine[at - 1][0] + self.gap[donor] > g:  # a move that raises the sum of squares
                n, k = mine.pop(at - 1)
                self.items[t].append(k)
                self.gap[t] -= n
                self.gap[donor] += n
                done = True
                continue
            best = (0, None, ())
            for k in self.items[t]:
                limit = size[k] + g
                at = bisect_right(mine, (limit, len(size)))
                if at and (gain := mine[at - 1][0] - size[k]) > best[0]:
                    best = (gain, k, (mine[at - 1],))
                lo, hi = 0, len(mine) - 1  # two of the donor's for one
                while lo < hi:
                    two = mine[lo][0] + mine[hi][0]
                    if two > limit:
                        hi -= 1
                    else:
                        if two - size[k] > best[0]:
                            best = (two - size[k], k, (mine[lo], mine[hi]))
                        lo += 1
                if best[0] == g:
                    break
            gain, k, given = best
            if k is not None and gain + self.gap[donor] > g:  # so does an exchange
                self.items[t].remove(k)
                for x in given:
                    mine.remove(x)
                    self.items[t].append(x[1])
                insort(mine, (size[k], k))
                self.gap[t] -= gain
                self.gap[donor] += gain
                done = True
        self.items[donor] = [k for _, k in mine]
        return done


def pack_lengths(size: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers."""
    bins = Bins(size, capacity)
    bins.best_fit()
    bins.search()
    return [x for x in bins.items if x]


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, first_id: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    next_id = first_id | (task.partitionId() if task else 0) << 32
    held: list[tuple] = []

    def place(last: bool) -> pa.RecordBatch | None:
        nonlocal held, next_id
        bins = pack_lengths([r[3] for r in held], capacity)
        fill = [sum(held[k][3] for k in b) for b in bins]
        order = sorted(range(len(bins)), key=fill.__getitem__)
        carried = set() if last else {b for b in order[: min(CARRIED, len(order) // 2)] if fill[b] < OPEN_BELOW * capacity}
        out = []
        for b, ks in enumerate(bins):
            if b not in carried:
                at = 0
                for k in sorted(ks, key=lambda k: held[k][:2] if held[k][0] is not None else (-1, held[k][1])):
                    out.append((*held[k], next_id, at, fill[b] < OPEN_BELOW * capacity))
                    at += held[k][3]
                next_id += 1
        held = [held[k] for b in carried for k in bins[b]]
        if not out:
            return None
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for lo in range(0, batch.num_rows, 4_000):
            held += zip(*(c.to_pylist() for c in batch.slice(lo, 4_000).columns), strict=True)
            if len(held) >= BLOCK and (found := place(False)):
                yield found
    if held and (found := place(True)):
        yield found


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset: as few sequences of at most ``capacity`` tokens as it can."""
    spark = cut.sparkSession
    ship(spark)
    spread = cut.repartition(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id())).sortWithinPartitions("doc_id", "piece", "ids_crc32")
    placed = materialize(spread.transform(tidy, lambda b: _packed(b, capacity, 0), _PLACED), "packed")
    left = placed.where("open")
    tasks = max(1, left.count() // BLOCK)
    again = left.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id())).sortWithinPartitions("doc_id", "piece", "ids_crc32")
    again = again.transform(tidy, lambda b: _packed(b, capacity, 1 << 60), _PLACED)
    return placed.where("not open").union(again).drop("open")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col), capacity)
