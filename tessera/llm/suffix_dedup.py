"""Suffix-array dedup (operator 9): bytes that a smaller document repeats are removed.

A byte goes if it lies in a ``WIDTH``-byte string that also starts in a document with a smaller id.
Whole copies are told by digest first. In all other texts each window of WIDTH bytes has an anchor, its
smallest hashed ``GRAM``-byte string, and as many bytes again left or right of it; windows of equal bytes
have equal anchors and an equal left or right side. A first scan finds which anchors with a side occur in
two or more documents (4 bytes each are shuffled) and marks them in a bit map, whose size grows with the
text from 32 to 128 MB and no further, the only thing broadcast beside bounded filters: it may let some pass in
vain, more of them as it fills up, but never holds one back. A second scan cuts the segments of windows
whose anchor passes with the side that they hold. They are shuffled by bucket of anchor, of about ``BUCKET``
bytes of text each, equal ones collapsed before, and put in blocks whose suffix arrays (see gsaca) give each
window the smallest document that holds it. A segment that many documents of a scan share (hot) moves
without its places, which get the verdict by a lookup. A bucket that an anchor overfills, such as one at the
edge of a passage that a third of all documents share, is shuffled on by window: equal windows meet, each with
the smallest document of its scan, and no task holds an anchor's windows. Spans go back to the documents by id.

Defined results: a null or empty text, or one under WIDTH bytes, loses nothing; a null id counts as
smaller than any other; rows that repeat an id and a text don't remove each other; spans are merged
where they overlap or touch; where text is wanted back, characters cut in part are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import gsaca, jvm
from tessera.llm.common import lookup, materialize, python_batches, ship, texts, tidy, trim

WIDTH, GRAM = 50, 16
#: log2 of the bits of the anchor map: least (32 MB) and most (128 MB).
MAP_BITS = (28, 30)
#: Bytes of text scanned at once, of texts before a flush, and of segments in a suffix array.
AT_ONCE, FLUSH, BLOCK = 1 << 19, 16_000_000, 1 << 18
#: Bytes that a table of segments may take in a worker, about, before it is flushed.
HELD = 35_000_000
#: Occurrences of a segment in a flush that travel with it; more are hot and get their verdict by a lookup.
TRAVEL = 64
#: Bytes of text for each bucket of anchors; bytes of segments in a bucket beyond which its windows are shuffled on their own.
BUCKET, ANCHOR_BYTES = 8_000_000, 64_000_000
_LOWEST = -(2**63)
_M64 = 2**64 - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def anchors(docs: list[bytes], width: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: document, first window, windows, anchor, and two keys of wider strings.

    The anchor is the leftmost smallest of the hashed ``gram``-byte strings in a window. A window holds
    ``side`` more bytes left or right of it, so equal windows have an equal left key (of those bytes and
    the anchor) or right key. ``split`` gives the windows of a run that hold the left (before the first
    number) and the right bytes (from the second on).
    """
    size = np.array([len(d) for d in docs], np.int64)
    wins = np.maximum(size - width + 1, 0)
    total = int(wins.sum())
    names = ("doc", "pos", "wins", "anchor", "left", "right", "has_left", "has_right", "split_left", "split_right")
    if not total:
        return {k: np.zeros(0, np.uint64 if k in ("anchor", "left", "right") else bool if k[:3] == "has" else np.int64) for k in names}
    h = np.frombuffer(b"".join(docs), np.uint8).astype(np.uint64) + np.uint64(1)
    gram, step, by = min(GRAM, max(1, width // 2)), 1, 0x9E3779B97F4A7C15
    while step * 2 <= gram:
        h = h[:-step] * np.uint64(by) + h[step:]
        by, step = by * by & _M64, step * 2
    side = min(step, (width - step) // 2)
    wide = h[: len(h) - side] * np.uint64(by) + h[side:]  # tells apart strings of step + side bytes
    h = _mixed(h)
    span, have = width - step + 1, 1
    x = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    while have * 2 <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if span > have:
        x = np.minimum(x[: -(span - have)], x[span - have :])
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(docs)), wins)
    pos = np.arange(total) - np.repeat(np.cumsum(wins) - wins, wins)
    at = (x[np.repeat(begin, wins) + pos] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    doc, pos, at, n = doc[first], pos[first], at[first], np.diff(np.r_[first, total])
    place = at - begin[doc]
    last = pos + n - 1
    has_left, has_right = pos <= place - side, last >= place + step + side - width
    wide = _mixed(wide)
    left, right = wide[np.where(has_left, at - side, 0)] ^ np.uint64(0x5851F42D4C957F2D), wide[np.where(has_right, at, 0)]
    columns = (doc, pos, n, h[at], left, right, has_left, has_right, np.minimum(last, place - side) + 1, np.maximum(pos, place + step + side - width))
    return dict(zip(names, columns, strict=True))


def _scans(batches: Iterator[pa.RecordBatch], width: int):
    """(ids, texts as bytes, anchors) of groups of whole texts of about AT_ONCE bytes."""
    for ids, part in python_batches(batches, AT_ONCE):
        docs = [t.encode() for t in part]
        yield ids, docs, anchors(docs, width)


def _planes(keys: np.ndarray) -> bytes:
    """Sorted 4-byte keys as their differences, byte by byte, compressed: about 2.5 bytes a key."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _sorted(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _seen(batches: Iterator[pa.RecordBatch], width: int, slice_bits: int) -> Iterator[pa.RecordBatch]:
    """(slice, anchors once each, those in several documents) of each flush; anchors as 4 bytes within a slice."""
    shift = np.uint64(64 - slice_bits - 32)
    held: list = []
    size = base = 0

    def flush():
        u, d = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        u = u >> shift
        order = np.argsort(u, kind="stable")
        u, d = u[order], d[order]
        first = np.r_[True, u[1:] != u[:-1]]
        at = np.flatnonzero(first)
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        u = u[at]
        cut = np.searchsorted(u >> np.uint64(32), np.arange((1 << slice_bits) + 1, dtype=np.uint64))
        low = u.astype("<u4")
        rows = [(k, _planes(low[a:b]), _planes(low[a:b][several[a:b]])) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "once", "several"])

    for ids, docs, run in _scans(batches, width):
        if len(run["doc"]):
            u = np.concatenate([run["left"][run["has_left"]], run["right"][run["has_right"]]])
            held.append((u, np.concatenate([run["doc"][run["has_left"]], run["doc"][run["has_right"]]]) + base))
        base += len(ids)
        size += sum(map(len, docs))
        if size >= FLUSH and held:
            yield flush()
            size = 0
    if held:
        yield flush()


def _mapped(batches: Iterator[pa.RecordBatch], slice_bits: int, map_bits: int) -> Iterator[pa.RecordBatch]:
    """(slice, its part of the bit map), of rows sorted by slice."""
    last, parts = None, []

    def close():
        once = np.concatenate([_sorted(a) for a, _ in parts])
        once.sort()
        rep = once[1:][once[1:] == once[:-1]]
        rep = np.concatenate([rep, *[_sorted(b) for _, b in parts]])
        bits = np.zeros(1 << (map_bits - slice_bits), bool)
        bits[rep >> np.uint32(32 + slice_bits - map_bits)] = True
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)])], ["slice", "bits"])

    for b in batches:
        for k, once, several in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != last and parts:
                yield close()
                parts = []
            last = k
            parts.append((once, several))
    if parts:
        yield close()


_SEGMENTS = "bucket int, places boolean, size long, packed binary"
#: What a packed row holds: of segments, or of the places of one hot segment.
_ENTRY = ("<i8", "<u4", "?", "<i8", "<i8", "<u4", "<i8", "<u4", "<u4", "S")
_PLACES = ("S", "<i8", "<u4", "<u4")


def _pack(columns: list) -> bytes:
    raw = [c if c.__class__ is bytes else c.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(r) for r in raw], "<u4").tobytes() + b"".join(raw))


def _unpack(packed: bytes, kinds: tuple[str, ...]) -> list:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(raw, "<u4", len(kinds))).tolist()
    base = 4 * len(kinds)
    parts = [raw[base + a : base + b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [x if k == "S" else np.frombuffer(x, k) for x, k in zip(parts, kinds, strict=True)]


def _flushed(table: dict[bytes, list], travel: int, buckets: int, flush: int) -> pa.RecordBatch:
    """Packed rows of distinct segments by bucket of anchor; places of hot segments are spread over all buckets."""
    segments = list(table)
    anchor = np.array([table[s][0] for s in segments], np.int64)
    bucket = (anchor.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((anchor, bucket))
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        mine = order[cut[k] : cut[k + 1]].tolist()
        entries = [table[segments[m]] for m in mine]
        hot = [len(e[1]) > travel for e in entries]
        for m, e, h in zip(mine, entries, hot, strict=True):
            if h:
                places = [xxhash.xxh3_128_digest(segments[m]), np.array(e[1], "<i8"), np.array(e[2], "<u4"), np.array(e[3], "<u4")]
                rows.append(((k + 1 + flush) % buckets, True, 0, _pack(places)))
        flat = lambda c, kind: np.array([x for e, h in zip(entries, hot, strict=True) if not h for x in e[c]], kind)
        columns = [
            np.diff(anchor[mine], prepend=np.int64(0)), np.array([len(segments[m]) for m in mine], "<u4"), np.array(hot, "?"),
            np.array([min(e[1]) for e in entries], "<i8"), np.array([max(e[1]) for e in entries], "<i8"),
            np.array([0 if h else len(e[1]) for e, h in zip(entries, hot, strict=True)], "<u4"), flat(1, "<i8"), flat(2, "<u4"), flat(3, "<u4"), b"".join([segments[m] for m in mine]),
        ]
        rows.append((k, False, sum(len(c) if c.__class__ is bytes else c.nbytes for c in columns), _pack(columns)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["bucket", "places", "size", "packed"])


def _segments(batches: Iterator[pa.RecordBatch], width: int, travel: int, buckets: int, map_bits: int, passing) -> Iterator[pa.RecordBatch]:
    """Distinct segments of a flush, with the documents and places they occur in."""
    bits = np.frombuffer(passing.value, np.uint8)
    task = TaskContext.get()
    flush = task.partitionId() if task else 0
    table: dict[bytes, list] = {}
    held = 0
    passes = lambda key: (bits[key >> np.uint64(64 - map_bits + 3)] >> (key >> np.uint64(64 - map_bits) & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    for ids, docs, run in _scans(batches, width):
        left, right = run["has_left"] & passes(run["left"]), run["has_right"] & passes(run["right"])
        lo, hi = np.where(left, run["pos"], run["split_right"]), np.where(right, run["pos"] + run["wins"], run["split_left"])
        keep = np.flatnonzero((left | right) & (lo < hi))
        tags: dict[int, int] = {}
        for d, p, q, a in zip(run["doc"][keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), run["anchor"][keep].view(np.int64).tolist(), strict=True):
            text = docs[d]
            if (tag := tags.get(d)) is None:
                tags[d] = tag = xxhash.xxh64_intdigest(text, 42) & 0xFFFFFFFF
            s = text[p : q + width - 1]
            if (row := table.get(s)) is None:
                table[s] = row = [a, [], [], []]
                held += len(s) + 600
            row[1].append(ids[d])
            row[2].append(tag)
            row[3].append(p)
            held += 100
        if held >= HELD:
            yield _flushed(table, travel, buckets, flush)
            table, held, flush = {}, 0, flush + 7
    if table:
        yield _flushed(table, travel, buckets, flush)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of distinct segments, cut between anchors, of packed rows sorted by bucket.

    An anchor of one document has nothing to lose and is left out. A segment that is alone under its
    anchor equals no other, so it is given its smallest document here and is not sorted.
    """
    rows: list[tuple] = []
    size = 0

    def block():
        flat = lambda k, kind: np.concatenate([np.zeros(0, kind), *[r[k] for r in rows]]).astype(kind).tobytes()
        sort = [r for r in rows if not r[3]]
        out = [
            np.array([len(r[0]) - width + 1 for r in rows], "<i4").tobytes(),
            np.array([r[3] for r in rows], "?").tobytes(),
            np.array([r[1] for r in rows], "<i8").tobytes(),
            np.array([len(r[4]) for r in rows], "<i4").tobytes(),
            flat(4, "<i8"), flat(5, "<i8"), flat(6, "<i4"),
            np.array([r[2] for r in rows], "?").tobytes(),
            b"".join(r[7] for r in rows if r[2]),
            gsaca.pack_block([r[0] for r in sort], [r[1] for r in sort]),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in out], _BLOCK_NAMES)

    def bucket(packed: list[bytes]):
        nonlocal rows, size
        parts = [_unpack(x, _ENTRY) for x in packed]
        anchor = np.concatenate([np.cumsum(x[0]) for x in parts])
        length, hot, low, high, count = (np.concatenate([x[k] for x in parts]) for k in range(1, 6))
        docs, tags, starts = (np.concatenate([x[k] for x in parts]) for k in range(6, 9))
        text = b"".join([x[9] for x in parts])
        text_end, place_end = np.cumsum(length, dtype=np.int64), np.cumsum(count, dtype=np.int64)
        order = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
        useful = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
        last = np.r_[first[1:], len(order)]
        for lo, hi in zip(first[useful].tolist(), last[useful].tolist(), strict=True):
            one: dict[bytes, list] = {}
            for k in order[lo:hi].tolist():
                s = text[text_end[k] - length[k] : text_end[k]]
                at = slice(place_end[k] - count[k], place_end[k])
                if (had := one.get(s)) is None:
                    one[s] = [int(low[k]), bool(hot[k]), [docs[at]], [tags[at]], [starts[at]]]
                else:
                    had[0], had[1] = min(had[0], int(low[k])), had[1] or bool(hot[k])
                    for list_, x in zip(had[2:], (docs, tags, starts), strict=True):
                        list_.append(x[at])
            alone = len(one) == 1
            for s, (smallest, is_hot, d, t, p) in one.items():
                places = ((x[0] if len(x) == 1 else np.concatenate(x)) for x in (d, t, p))
                rows.append((s, smallest, is_hot, alone, *places, xxhash.xxh3_128_digest(s) if is_hot else b""))
                size += len(s)
            if size >= BLOCK:
                yield block()
                rows, size = [], 0

    held: list[bytes] = []
    last = None
    for b in batches:
        for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != last and held:
                yield from bucket(held)
                held = []
                trim()
            last = k
            held.append(packed)
    if held:
        yield from bucket(held)
    if rows:
        yield block()


_BLOCK_NAMES = ["wins", "alone", "low", "count", "docs", "tags", "starts", "hot", "keys", "block"]
_BLOCK_SCHEMA = ", ".join(f"{c} binary" for c in _BLOCK_NAMES)


def _spans(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Removed spans (m_id, m_tag, s, e) of occurrences that travelled; for hot segments (key, s, e, low) of runs of windows."""
    for b in batches:
        for wins, alone, low, count, docs, tags, starts, hot, keys, minima in zip(*(c.to_pylist() for c in b.columns), strict=True):
            read = lambda x, kind: np.frombuffer(x, kind).astype(np.int64 if kind != "?" else bool)
            wins, alone, low, count, hot = read(wins, "<i4"), read(alone, "?"), read(low, "<i8"), read(count, "<i4"), read(hot, "?")
            lows = np.repeat(low, wins)
            lows[np.repeat(~alone, wins)] = read(minima, ">i8")
            seg, begin = np.repeat(np.arange(len(wins)), wins), np.cumsum(wins) - wins
            first = np.flatnonzero(np.r_[True, (lows[1:] != lows[:-1]) | (seg[1:] != seg[:-1])])
            run_seg, run_at, run_n, run_low = seg[first], first - begin[seg[first]], np.diff(np.r_[first, len(lows)]), lows[first]
            runs = np.bincount(run_seg, minlength=len(wins))
            run_first = np.cumsum(runs) - runs
            occ_seg = np.repeat(np.arange(len(wins)), count)
            docs, tags, starts = read(docs, "<i8"), read(tags, "<i8"), read(starts, "<i4")
            times = runs[occ_seg]
            occ = np.repeat(np.arange(len(docs)), times)
            run = np.arange(len(occ)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(run_first[occ_seg], times)
            hit = run_low[run] < docs[occ]
            occ, run = occ[hit], run[hit]
            at = starts[occ] + run_at[run]
            none = pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(docs[occ]), pa.array(tags[occ]), pa.array(at), pa.array(at + run_n[run] + width - 1), none, pa.array(run_low[run])], _SPAN_NAMES)
            if hot.any():
                number = np.cumsum(hot) - 1
                mine = np.flatnonzero(hot[run_seg])
                key = pa.array([keys[16 * k : 16 * k + 16] for k in number[run_seg[mine]].tolist()], pa.binary())
                none = pa.nulls(len(mine), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(run_at[mine]), pa.array(run_at[mine] + run_n[mine] + width - 1), key, pa.array(run_low[mine])], _SPAN_NAMES)


_SPAN_NAMES = ["m_id", "m_tag", "s", "e", "key", "low"]
_SPAN_SCHEMA = "m_id long, m_tag long, s long, e long, key binary, low long"


#: What a packed row of windows holds: bytes, smallest documents, numbers of places, places, numbers of hot segments, their keys and offsets.
_WINDOWS = ("S", "<i8", "<u4", "<i8", "<u4", "<u4", "<u4", "S", "<u4")


def _cut(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of segments as packed rows of their windows by bucket of the window's hash, equal ones of a row collapsed."""
    for b in batches:
        for packed in b.column(0).to_pylist():
            _, length, hot, low, _, count, docs, tags, starts, text = _unpack(packed, _ENTRY)
            text_end, place_end = np.cumsum(length, dtype=np.int64).tolist(), np.cumsum(count, dtype=np.int64).tolist()
            table: dict[bytes, list] = {}
            for k, (n, is_hot, least, times) in enumerate(zip(length.tolist(), hot.tolist(), low.tolist(), count.tolist(), strict=True)):
                s = text[text_end[k] - n : text_end[k]]
                key = xxhash.xxh3_128_digest(s) if is_hot else None
                at = slice(place_end[k] - times, place_end[k])
                for o in range(n - width + 1):
                    had = table.setdefault(s[o : o + width], [least, [], []])
                    had[0] = min(had[0], least)
                    had[1].append((at, o))
                    if is_hot:
                        had[2].append((key, o))
            parts: dict[int, list] = {}
            for w in table:
                parts.setdefault(xxhash.xxh3_64_intdigest(w) % buckets, []).append(w)
            rows = []
            for bucket, mine in parts.items():
                entries = [table[w] for w in mine]
                places = [x for e in entries for x in e[1]]
                join = lambda c, kind: np.concatenate([np.zeros(0, kind), *[c[at] for at, _ in places]]).astype(kind)  # noqa: E731, B023
                shifted = np.concatenate([np.zeros(0, "<u4"), *[starts[at] + np.uint32(o) for at, o in places]]).astype("<u4")
                refs = [r for e in entries for r in e[2]]
                columns = [
                    b"".join(mine), np.array([e[0] for e in entries], "<i8"), np.array([sum(at.stop - at.start for at, _ in e[1]) for e in entries], "<u4"), join(docs, "<i8"), join(tags, "<u4"), shifted,
                    np.array([len(e[2]) for e in entries], "<u4"), b"".join([r[0] for r in refs]), np.array([r[1] for r in refs], "<u4"),
                ]
                rows.append((bucket, _pack(columns)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], ["bucket", "packed"])


def _window_spans(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The same spans as _spans gives, of packed rows of windows sorted by bucket: the smallest document of each window, then the places beyond it."""

    def bucket(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for x in packed:
            text, low, *_ = _unpack(x, _WINDOWS)
            for k, n in enumerate(low.tolist()):
                w = text[k * width : (k + 1) * width]
                if least.setdefault(w, n) > n:
                    least[w] = n
        for x in packed:
            text, low, count, docs, tags, starts, n_refs, keys, shift = _unpack(x, _WINDOWS)
            lows = np.array([least[text[k * width : (k + 1) * width]] for k in range(len(low))], np.int64)
            of = np.repeat(lows, count)
            hit = np.flatnonzero(of < docs)
            at, none = starts[hit].astype(np.int64), pa.nulls(len(hit), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(docs[hit]), pa.array(tags[hit].astype(np.int64)), pa.array(at), pa.array(at + width), none, pa.array(of[hit])], _SPAN_NAMES)
            if len(shift):
                at, none = shift.astype(np.int64), pa.nulls(len(shift), pa.int64())
                named = pa.array([keys[16 * k : 16 * k + 16] for k in range(len(shift))], pa.binary())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(at), pa.array(at + width), named, pa.array(np.repeat(lows, n_refs))], _SPAN_NAMES)

    held: list[bytes] = []
    last = None
    for b in batches:
        for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != last and held:
                yield from bucket(held)
                held = []
            last = k
            held.append(packed)
    if held:
        yield from bucket(held)


def _hot_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packed in b.column(0).to_pylist():
            key, docs, tags, starts = _unpack(packed, _PLACES)
            columns = [pa.array([key] * len(docs), pa.binary()), pa.array(docs.astype(np.int64)), pa.array(tags.astype(np.int64)), pa.array(starts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "docs", "texts", "starts"])


def _tag(text) -> Column:
    """Tells apart rows that repeat an id: the low half of a text's hash."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def marks(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", engine: str = "jvm", travel: int = TRAVEL, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(m_id, m_tag, whole, starts, ends, n) of the texts that lose bytes; m_tag is half of the text's xxhash64, n the rows that have both."""
    spark = docs.sparkSession
    ship(spark)
    source = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc_id"), "text", F.unhex(F.sha2("text", 256)).alias("key"))
    rows = materialize(source.select("doc_id", _tag("text").alias("tag"), F.octet_length("text").alias("size"), "key"), "suffix-digests")
    told = rows.agg(F.count("key").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes")).first()
    size = told.bytes or 0
    groups = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("key").alias("n")).where("n > 1"), "suffix-copies")
    copies = lookup(rows, groups, "key", "n", told.n).where(f"doc_id > first and size >= {width}")
    copies = copies.groupBy(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag")).agg(F.count("key").alias("n"))
    copies = materialize(copies, "suffix-copied")
    own = lookup(source, groups, "key", "n", told.n).where(f"first is null or doc_id <= first or octet_length(text) < {width}").select("doc_id", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    map_bits = min(MAP_BITS[1], max(MAP_BITS[0], size.bit_length() - 5))
    slice_bits = min(16, max(8, (4 * partitions - 1).bit_length(), (size // FLUSH).bit_length()))
    seen = own.transform(tidy, lambda b: _seen(b, width, slice_bits), "slice int, once binary, several binary")
    mapped = seen.repartition("slice").sortWithinPartitions("slice").transform(tidy, lambda b: _mapped(b, slice_bits, map_bits), "slice int, bits binary")
    part = 1 << (map_bits - slice_bits - 3)
    bits = bytearray(1 << (map_bits - 3))
    for row in mapped.toLocalIterator():  # at most 128 MB in all
        bits[row.slice * part : (row.slice + 1) * part] = zlib.decompress(row.bits)
    passing = spark.sparkContext.broadcast(bits)
    buckets = max(4 * partitions, size // BUCKET)
    found = materialize(own.transform(tidy, lambda b: _segments(b, width, travel, buckets, map_bits, passing), _SEGMENTS), "suffix-segments")
    passing.unpersist()
    entries = found.where("not places").select("bucket", "size", "packed")
    heavy = materialize(entries.groupBy("bucket").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > anchor_bytes), "suffix-heavy")
    heavy_bytes = heavy.agg(F.sum("bytes")).first()[0] or 0
    light = entries.join(heavy.select("bucket"), "bucket", "left_anti") if heavy_bytes else entries
    tasks = max(partitions, buckets // 16)
    blocks = light.select("bucket", "packed").repartition(tasks, "bucket").sortWithinPartitions("bucket").transform(tidy, lambda b: _blocks(b, width), _BLOCK_SCHEMA)
    if engine == "jvm":
        java = gsaca.SOURCE.replace("WIDTH", str(width)).replace("WindowMinima", f"WindowMinima{width}")  # class names are global
        name = jvm.register(spark, f"tessera_window_minima_{width}", f"{gsaca.CLASS}{width}", java, "binary")
        solved = blocks.select(*_BLOCK_NAMES[:-1], F.expr(f"{name}(block)").alias("minima"))
    else:
        solved = blocks.transform(tidy, lambda b: _python_minima(b, width), _BLOCK_SCHEMA.replace("block", "minima"))
    spans = solved.transform(tidy, lambda b: _spans(b, width), _SPAN_SCHEMA)
    if heavy_bytes:
        windows = max(partitions, 20 * heavy_bytes // BUCKET)
        cut = entries.join(heavy.select("bucket"), "bucket", "left_semi").select("packed").transform(tidy, lambda b: _cut(b, width, windows), "bucket int, packed binary")
        cut = cut.repartition(max(partitions, windows // 16), "bucket").sortWithinPartitions("bucket")
        spans = spans.union(cut.transform(tidy, lambda b: _window_spans(b, width), _SPAN_SCHEMA))
    spans = materialize(spans, "suffix-spans")
    hot = spans.where("key is not null").groupBy("key").agg(F.collect_set(F.struct("s", "e", "low")).alias("runs"))  # a segment has at most one run a window
    spans = spans.where("key is null").select("m_id", "m_tag", "s", "e")
    if not hot.isEmpty():
        places = materialize(found.where("places").select("packed").transform(tidy, _hot_places, "key binary, docs long, texts long, starts long"), "suffix-hot-places")
        sizes = places.groupBy("key").agg(F.count("docs").alias("n"))
        index = materialize(hot.join(sizes, "key"), "suffix-hot-runs")
        hit = lookup(places, index, "key", "n", places.count()).select("docs", "texts", "starts", F.explode("runs").alias("r")).where("r.low < docs")
        spans = spans.union(hit.select("docs", "texts", F.col("starts") + F.col("r.s"), F.col("starts") + F.col("r.e")))
    one = F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))
    lists = spans.groupBy("m_id", "m_tag").agg(F.sort_array(F.collect_set(one)).alias("spans"), F.count("s").alias("found"))
    lists = lists.select("m_id", "m_tag", F.lit(False).alias("whole"), F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends"), F.expr("found div size(spans)").alias("n"))
    none = F.array().cast("array<int>")
    return materialize(lists.union(copies.select("m_id", "m_tag", F.lit(True), none, none, "n")), "suffix-marks")


def _python_minima(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [gsaca.window_minima(x, width).astype(">i8").tobytes() for x in b.column(len(_BLOCK_NAMES) - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*_BLOCK_NAMES[:-1], "minima"])


def _marked(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the columns of marks beside them; only texts that lose bytes move (and few that the filter lets pass)."""
    keys = ["__tessera_m_id", "__tessera_m_tag"]
    index = found.toDF(*keys, "_m_whole", "_m_starts", "_m_ends", "_m_n")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({keys[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)), keys[1]: _tag(text)})
    return lookup(keyed, index, keys, "_m_n", docs.count())


def merged(starts: list[int], ends: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in zip(starts, ends, strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def left(raw: bytes, spans: list[list[int]]) -> bytes:
    at = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def digests(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs."""
    source = texts(docs, id_col, text_col)
    beside = _marked(source, marks(source, width, **options), "doc_id", "text").select("doc_id", "text", "_m_whole", "_m_starts", "_m_ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, whole, starts, ends in zip(*b.columns, strict=True):
                raw = text.as_py().encode()
                spans = [] if not whole.is_valid else [[0, len(raw)]] if whole.as_py() else merged(starts.as_py(), ends.as_py())
                kept = left(raw, spans)
                rows.append((i.as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return beside.transform(tidy, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with all columns, repeated bytes taken out of the text."""
    columns = docs.columns
    beside = _marked(docs, marks(docs, width, id_col, text_col, **options), id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text_col)
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 500):
                b = whole_batch.slice(lo, 500)
                out = ["" if w.as_py() else left((t.as_py() or "").encode(), merged(s.as_py(), e.as_py())).decode(errors="ignore") for t, w, s, e in zip(b.column(at), *b.columns[-3:], strict=True)]
                arrays = b.columns[:-3]
                arrays[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, columns)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema])
    lost = beside.where("_m_whole is not null").select(*columns, "_m_whole", "_m_starts", "_m_ends").transform(tidy, cut, schema)
    return beside.where("_m_whole is null").select(*columns).union(lost)
