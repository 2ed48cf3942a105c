"""Plain versions of the operators' results, for small tables: rows are (doc_id, text)."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_bpe = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def encode(text):
    return _bpe.encode(text or "", add_special_tokens=False).ids


def bpe(rows):
    out = []
    for i, t in rows:
        ids = encode(t)
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(_bpe.decode(ids, skip_special_tokens=False))))
    return out


def exact(rows, best=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: best([i for i in v if i is not None], default=None) for t, v in groups.items()}
    return [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha(t or "")) for i, t in rows]


def quality(rows):
    from tessera.llm import quality as q

    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = len(w) < 10 or 100 * len(again) > 20 * len(w)
        good = []
        for x in lines:
            n, seps, marked = len(re.findall(q.SYMBOLS, x)), len(re.findall(q.SEPARATORS, x)), re.search(q.MARKS, x)
            bad = n >= 2 and n * q.PER_SYMBOL > len(x) or x.count("!!") * q.PER_SHOUT > len(x)
            bad = bad or len(x) >= q.LONG_LINE and not marked and not re.search(q.UNMARKED, x)
            if len(x) <= q.SHORT_LINE:
                bad = bad or re.search(q.BOILERPLATE, x) or not marked and seps >= 2 and (seps + 1) * q.NAV_ITEM >= len(x)
                bad = bad or re.search(q.LINK, x) and not re.search(q.TWO_WORDS, x)
            bad = bad or len(x) <= q.LABEL and re.sub(q.SPACE, " ", x).lower().strip(" ") in q.LABELS
            if not bad:
                good.append(x)
        enough = len("".join(good)) * 100 >= q.MIN_LEFT * len("".join(lines))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), base, enough and not base, good, len(lines) - len(good)))
    return out


def warc(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        first = min((x for x in groups[t or ""] if x is not None), default=None)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return out


def suffix(rows, width=50):
    low = -(2**63)
    docs = [(low if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for k, _, b in docs:
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < k:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1])), sha(kept), kept))
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def component_of(fps, most=2):
    """The number of the component of each fingerprint."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(fps, np.uint64)
    for x in range(len(fps)):
        for y in (np.flatnonzero(np.bitwise_count(a[x + 1 :] ^ a[x]) <= most) + x + 1).tolist():
            p, q = find(x), find(y)
            up[max(p, q)] = min(p, q)
    return [find(x) for x in range(len(fps))]


def simhash(rows):
    fps = [fingerprint(t) for _, t in rows]
    comp = component_of(fps)
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return [(i, f"{f:016x}", low.get(c)) for (i, _), f, c in zip(rows, fps, comp, strict=True)]
