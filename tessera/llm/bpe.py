"""BPE encoding and decoding (operator 1) by contiguous rank arrays.

A word of at most ``SHORT`` bytes is a row of part ids beside a row of the ranks of adjacent parts.
The smallest rank is found by a scan, its boundary is deleted and the two ranks beside it are looked
up again, until no pair has a rank. Words of equal length are advanced together as numpy matrices, as
each step takes exactly one part from every word that still merges. Longer words use a heap.

Defined results: a null or empty text has no ids; the two special tokens are ids wherever they stand
in a text; ids are per row, so repeated rows and ids give repeated results; null ids are kept.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import python_batches, ship, texts, tidy, trim

#: Longest word, in bytes, that is held as a row of ranks.
SHORT = 64
#: Distinct white-space separated chunks whose ids a worker remembers (two generations of half as many).
CACHE = 480_000
#: Characters of a text that are encoded at once; cut at a space.
SLICE = 1 << 20
#: Characters of texts whose distinct chunks are encoded together where ids are all that is asked for.
TOGETHER = 1 << 22
#: Bits of a slot in the table of pairs: about 21 slots a pair of a vocabulary of 49,152.
SLOT_BITS = 20
_NONE = np.int32(2**31 - 1)


@lru_cache
def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encodes as the tokenizers library does for a file whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        end, chars = model.get("end_of_word_suffix") or "", byte_chars()
        self.token = dict((i, s) for s, i in vocab.items()) | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        self.to_byte = {c: b for b, c in enumerate(chars)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if end:
            for r, (a, b) in enumerate(pairs):  # a left part never carries the suffix
                assert not a.endswith(end), (r, a, b)
        self.pairs = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        slot = _slot(self.keys)
        self.place = np.full(1 << SLOT_BITS, -1, np.int32)  # of a slot's one pair; -1: it has none, -2: several
        self.place[slot] = np.arange(len(slot), dtype=np.int32)
        self.place[np.bincount(slot, minlength=1 << SLOT_BITS) > 1] = -2
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        del spec, vocab, pairs, keys, whole
        trim()
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, by a table of slots; pairs in a slot that several share are searched for."""
        key = left.astype(np.int64) << 32 | right
        at = self.place[_slot(key)]
        if (several := at == -2).any():
            at[several] = np.minimum(np.searchsorted(self.keys, key[several]), len(self.keys) - 1)
        out = np.full(key.shape, _NONE, np.int32)
        some = np.nonzero(at >= 0)
        at = at[some]
        out[some] = np.where(self.keys[at] == key[some], self.ranks[at], _NONE)
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit bytes, of words that all have the same length."""
        pool, size = self.merge_rows(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1))
        flat = pool.tobytes()
        return [flat[lo:hi] for lo, hi in pairwise((4 * np.r_[0, np.cumsum(size)]).tolist())]

    def merge_rows(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are rows of bytes, one word after another, and their numbers."""
        out, size = np.zeros(raw.shape, "<u4"), np.zeros(len(raw), np.int64)
        ids = self.first[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        who = np.arange(len(raw))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])

        def finish(who: np.ndarray, ids: np.ndarray) -> None:
            out[who, : ids.shape[1]], size[who] = ids, ids.shape[1]

        while len(who) and ids.shape[1] > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            if (done := best == _NONE).any():
                finish(who[done], ids[done])
                live = ~done
                who, ids, ranks, at, best = who[live], ids[live], ranks[live], at[live], best[live]
                if not len(who):
                    break
            n, row = ids.shape[1], np.arange(len(who))
            ids[row, at] = self.made[best]
            ids = ids[np.arange(n) != (at + 1)[:, None]].reshape(len(who), n - 1)
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(who), n - 2)
            if n > 2:
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < n - 2)
                ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])
        finish(who, ids)
        return out[np.arange(raw.shape[1]) < size[:, None]], size

    def merge_long(self, word: bytes) -> bytes:
        """The same for one word of any length, by a heap of pairs over linked parts."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        find = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (s := find(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (s, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def split(self, chunk: str) -> list[str | bytes]:
        """The words of a chunk without white space, as the file's splitter cuts them."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,!?;:|%&*$#" and (head := chunk[:-1]).isalpha():
            return [head, chunk[-1]]
        if chunk.isascii() or max(chunk) <= "\xff":
            return self.words.findall(chunk)
        return [bytes(map(self.to_byte.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(chunk)]

    def encode_chunks(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct chunk, as little-endian unsigned 32-bit bytes."""
        cut, by_size = {}, {}
        for c in chunks:
            if c[0] == " ":
                cut[c] = [c]
                continue
            cut[c] = words = [w if w.__class__ is bytes else w.encode() for w in self.split(c)]
            for w in words:
                if (n := len(w)) in by_size:
                    by_size[n].add(w)
                else:
                    by_size[n] = {w}
        known: dict = {" " + k: np.array([v], "<u4").tobytes() for k, v in self.special.items()}
        for size, found in by_size.items():
            found = list(found)
            known.update(zip(found, self.merge_short(found) if size <= SHORT else map(self.merge_long, found), strict=True))
        return {c: known[w[0]] if len(w) == 1 else b"".join([known[x] for x in w]) for c, w in cut.items()}

    def encode_distinct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these chunks, one chunk after another, and their numbers; an empty chunk has none."""
        words, n = [], np.zeros(len(chunks), np.int64)
        for k, c in enumerate(chunks):
            if c:
                found = [c] if c[0] == " " else self.split(c)
                words += found
                n[k] = len(found)
        named = pa.array([w if w.__class__ is bytes else w.encode() for w in words], pa.large_binary()).dictionary_encode()
        distinct, at = named.dictionary, named.indices.to_numpy()
        lo = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset :][: len(distinct) + 1]
        data, length = np.frombuffer(distinct.buffers()[2] or b"", np.uint8), np.diff(lo)
        is_special = data[lo[:-1]] == 32  # no other word has a space
        order, pools, sizes = [], [], []
        for size in np.unique(length[~is_special & (length <= SHORT)]).tolist():
            rows = np.flatnonzero((length == size) & ~is_special)
            pool, n_ids = self.merge_rows(data[lo[rows][:, None] + np.arange(size)])
            order.append(rows), pools.append(pool), sizes.append(n_ids)
        for k in np.flatnonzero(is_special | (length > SHORT)).tolist():
            w = distinct[k].as_py()
            pool = np.array([self.special[w[1:].decode()]], "<u4") if is_special[k] else np.frombuffer(self.merge_long(w), "<u4")
            order.append(np.array([k])), pools.append(pool), sizes.append(np.array([len(pool)]))
        if not order:
            return np.zeros(0, "<u4"), n
        order, pool, size = np.concatenate(order), np.concatenate(pools), np.concatenate(sizes)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ids, sums = gathered(pool, size, back[at])
        return ids, np.diff(sums[np.r_[0, np.cumsum(n)]])

    def joined(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes; of all their chunks only distinct ones are encoded."""
        plain = np.array([self.as_is(t) for t in texts], bool)
        cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.large_string())))
        lists = [self.chunks(t) for t, p in zip(texts, plain, strict=True) if not p]
        n = np.empty(len(texts), np.int64)
        n[plain], n[~plain] = cut.value_lengths().to_numpy(), [len(x) for x in lists]
        flat = pa.chunked_array([cut.flatten(), pa.array(list(chain.from_iterable(lists)), pa.large_string())]).dictionary_encode().combine_chunks()
        del cut
        ids, sums = gathered(*self.encode_distinct(flat.dictionary.to_pylist()), flat.indices.to_numpy())
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        raw, out = ids.tobytes(), [b""] * len(texts)
        for k, (lo, hi) in zip(order.tolist(), pairwise((4 * sums[np.r_[0, np.cumsum(n[order])]]).tolist()), strict=True):
            out[k] = raw[lo:hi]
        return out

    def chunks(self, text: str) -> list[str]:
        """A text as chunks between white space, normalised; special tokens are chunks of their own."""
        if self.cut and "<|" in text:
            out: list[str] = []
            for part in self.cut.split(text):
                out += [" " + part] if part in self.special else self.plain(part)  # no other chunk has a space
            return out
        return self.plain(text)

    def as_is(self, text: str) -> bool:
        """Whether a text is lowered and split at white space without the normalizer and special tokens."""
        return (text.isascii() or _latin1(text)) and not _ODD.search(text) and not (self.cut and "<|" in text)

    def plain(self, text: str) -> list[str]:
        # Latin-1 text is in NFC as it stands; Python takes \x1c to \x1f as white space, the normalizer doesn't.
        if (text.isascii() or _latin1(text)) and not _ODD.search(text):
            return text.lower().split()
        return [c for c in self.normalizer.normalize_str(text).split(" ") if c]


_ODD = re.compile("[\x1c-\x1f]")


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def gathered(pool: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs number ``at`` of a pool of runs of these sizes, one after another, and where each begins and the last ends."""
    n = size[at]
    sums = np.r_[0, np.cumsum(n)]
    kind = np.int32 if max(len(pool), sums[-1]) < 2**31 else np.int64
    where = np.repeat(((np.cumsum(size) - size)[at] - sums[:-1]).astype(kind), n)
    where += np.arange(sums[-1], dtype=kind)
    return pool[where], sums


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Remembered:
    """render(ids) of chunks, remembered in two generations so that memory stays bounded."""

    def __init__(self, bpe: WordBpe, render, size: int = CACHE):
        self.bpe, self.render, self.half, self.new, self.old = bpe, render, size // 2, {}, {}

    def rendered(self, lists: list[list[str]]) -> list[list]:
        """render(ids) of each chunk of these lists; each chunk is looked up once."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = [list(map(new.get, chunks)) for chunks in lists]
        miss: set[str] = set()
        for chunks, values in zip(lists, found, strict=True):
            if None in values:
                miss.update([c for c, v in zip(chunks, values, strict=True) if v is None])
        if miss:
            for c in miss & old.keys():
                new[c] = old[c]
            render = self.render
            for c, ids in self.bpe.encode_chunks(miss - old.keys()).items():
                new[c] = render(ids)
            found = [[new[c] if v is None else v for c, v in zip(chunks, values, strict=True)] if None in values else values for chunks, values in zip(lists, found, strict=True)]
        return found


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def slices(text: str) -> Iterator[str]:
    """A text in parts of about SLICE characters, cut at spaces only."""
    lo = 0
    while len(text) - lo > 2 * SLICE and (hi := text.find(" ", lo + SLICE)) >= 0:
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, token ids as little-endian unsigned 32-bit bytes) of (doc_id, text) batches."""
    bpe = load(path)
    for ids, docs in python_batches(batches, TOGETHER):
        out, group, held = [], [], 0
        for s in chain.from_iterable(map(slices, docs)):
            group.append(s)
            held += len(s)
            if held > TOGETHER:
                out += bpe.joined(group)
                group, held = [], 0
        yield ids, _joined(docs, out + bpe.joined(group), b"")


def _small_groups(bpe: WordBpe, docs: list[str]) -> Iterator[list[list[str]]]:
    """Chunk lists of the slices of docs, in groups that bound memory."""
    group, held = [], 0
    for d in docs:
        for s in slices(d):
            group.append(bpe.chunks(s))
            held += len(s)
            if held > SLICE:
                yield group
                group, held = [], 0
    if group:
        yield group


def _joined(docs: list[str], parts: list[bytes], between: bytes) -> list[bytes]:
    """The parts of each text put together; a slice of white space only has no tokens and takes no ``between``."""
    it = iter(parts)
    return [between.join([x for _ in slices(d) if (x := next(it))]) if len(d) > 2 * SLICE else next(it) for d in docs]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def run(batches):
        for ids, raw in encoded(path, batches):
            lists = [np.frombuffer(x, "<u4").astype(np.int32) for x in raw]
            at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), arrays], ["doc_id", "ids"])

    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).transform(tidy, run, "doc_id long, ids array<int>")


def decode(encoded_docs: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the tokens of an id array joined by a space, as a file without a decoder gives them."""

    def run(batches):
        token = load(path).token.__getitem__
        for b in batches:
            out = [" ".join(map(token, x or [])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    ship(encoded_docs.sparkSession)
    return encoded_docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").transform(tidy, run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, then decoded, digested in place.

    Ids and decoded text never leave the worker; a chunk's decimal ids and tokens are rendered once.
    """

    def run(batches):
        bpe = load(path)
        gc.disable()  # nothing here is cyclic, and the remembered chunks are many
        token = bpe.token.__getitem__
        cache = Remembered(bpe, lambda x: (" ".join(map(str, x := np.frombuffer(x, "<u4").tolist())), " ".join(map(token, x))))
        for ids, docs in python_batches(batches):
            coded, decoded = [], []
            for group in _small_groups(bpe, docs):
                for both in cache.rendered(group):
                    coded.append(" ".join([x[0] for x in both]).encode())
                    decoded.append(" ".join([x[1] for x in both]).encode())
            coded, decoded = (_joined(docs, x, b" ") for x in (coded, decoded))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([x.count(b" ") + 1 if x else 0 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).transform(tidy, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
