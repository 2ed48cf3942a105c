"""Suffix arrays by linear grouping construction, and the window minima that are read off them.

Suffixes are first grouped by their first byte. Groups are then taken in descending order; each member
finds its previous suffix (the next one to the left that lies in a lower group), and suffixes that are
previous to members are moved to new groups right above their old ones, those with most such members
highest. After that suffixes of a group share their Lyndon prefix. A second pass walks the result in
ascending order and follows previous-smaller pointers, each time putting a suffix first among those of
its group that have no place yet. No string is renamed and nothing recurses.

A block is a list of byte strings with an id each. For every window of ``width`` bytes within a string,
the smallest id of all strings of the block that hold the same bytes is found: equal windows are
neighbours in the suffix array. ``SOURCE`` is what runs in bulk; the Python functions are the same.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in order, the empty one first."""
    s = [x + 1 for x in text] + [0]
    n = len(s)
    start = np.cumsum(np.bincount(s, minlength=257)).tolist()
    start = [0, *start[:-1]]
    fill, sa, isa, group = start[:], [0] * n, [0] * n, [0] * n
    size = [0] * n
    for i, c in enumerate(s):
        sa[fill[c]], isa[i], group[i] = i, fill[c], start[c]
        size[start[c]] += 1
        fill[c] += 1
    up, prev, count, moved = list(range(n)), [-1] * n, [0] * n, [0] * n
    end = n
    while end:
        g = group[sa[end - 1]]
        members = sa[g:end]
        for i in members:
            up[i] = i - 1
        found = []
        for i in members:
            p = i
            while p >= 0 and up[p] != p:
                q = up[p]
                if q >= 0:
                    up[p] = up[q]
                p = q
            prev[i] = p
            if p >= 0:
                if not count[p]:
                    found.append(p)
                count[p] += 1
        found.sort(key=count.__getitem__, reverse=True)
        lo = 0
        while lo < len(found):
            hi = lo
            while hi < len(found) and count[found[hi]] == count[found[lo]]:
                p = found[hi]
                h = group[p]
                at, to = isa[p], h + size[h] - 1 - moved[h]
                q = sa[to]
                sa[at], sa[to], isa[q], isa[p] = q, p, at, to
                moved[h] += 1
                hi += 1
            for p in found[lo:hi]:
                h = group[p]
                if m := moved[h]:
                    new = h + size[h] - m
                    moved[h] = 0
                    if new != h:
                        size[h] -= m
                        size[new] = m
                        for k in range(new, new + m):
                            group[sa[k]] = new
            lo = hi
        for p in found:
            count[p] = 0
        end = g
    out, put, free = [0] * n, [False] * n, list(range(n))
    out[0], put[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = True
            j = prev[j]
    return out


def pack_block(strings: list[bytes], ids: list[int]) -> bytes:
    return b"".join([np.array([len(strings)], ">i4").tobytes(), np.array([len(x) for x in strings], ">i4").tobytes(), np.array(ids, ">i8").tobytes(), *strings])


def window_minima(block: bytes, width: int) -> np.ndarray:
    """The smallest id for each window of each string, in order of strings and starts."""
    n = int.from_bytes(block[:4], "big")
    size = np.frombuffer(block, ">i4", n, 4).astype(np.int64)
    ids = np.frombuffer(block, ">i8", n, 4 + 4 * n).tolist()
    text = block[4 + 12 * n :]
    slot, owner = [-1] * len(text), [0] * len(text)
    at = k = 0
    for s, m in enumerate(size.tolist()):
        for o in range(m - width + 1):
            slot[at + o], owner[at + o] = k, ids[s]
            k += 1
        at += m
    out = np.zeros(k, np.int64)
    same: list[int] = []

    def close() -> None:
        if same:
            out[[slot[p] for p in same]] = min(owner[p] for p in same)

    for p in suffix_array(text):
        if p < len(text) and slot[p] >= 0:
            if same and text[p : p + width] != text[same[0] : same[0] + width]:
                close()
                same = []
            same.append(p)
    close()
    return out


CLASS = "tessera.WindowMinima"
SOURCE = """
package tessera;

public class WindowMinima implements org.apache.spark.sql.api.java.UDF1 {

    public static int[] suffixArray(byte[] text, int from, int length) {
        int n = length + 1;
        int[] sa = new int[n], isa = new int[n], group = new int[n], size = new int[n];
        int[] up = new int[n], prev = new int[n], count = new int[n], moved = new int[n], found = new int[n], sorted = new int[n], tally = new int[n + 2];
        int[] start = new int[258], fill = new int[258];
        for (int i = 0; i < length; i++) start[(text[from + i] & 255) + 2]++;
        start[1]++;
        for (int c = 1; c < 258; c++) start[c] += start[c - 1];
        for (int c = 0; c < 258; c++) fill[c] = start[c];
        for (int i = 0; i < n; i++) {
            int c = i < length ? (text[from + i] & 255) + 1 : 0;
            int at = fill[c]++;
            sa[at] = i; isa[i] = at; group[i] = start[c]; size[start[c]]++; up[i] = i;
        }
        int end = n;
        while (end > 0) {
            int g = group[sa[end - 1]], many = 0, most = 0;
            for (int k = g; k < end; k++) up[sa[k]] = sa[k] - 1;
            for (int k = g; k < end; k++) {
                int i = sa[k], p = i;
                while (p >= 0 && up[p] != p) {
                    int q = up[p];
                    if (q >= 0) up[p] = up[q];
                    p = q;
                }
                prev[i] = p;
                if (p >= 0) {
                    if (count[p] == 0) found[many++] = p;
                    count[p]++;
                    if (count[p] > most) most = count[p];
                }
            }
            if (most > 1) {
                for (int k = 0; k <= most + 1; k++) tally[k] = 0;
                for (int k = 0; k < many; k++) tally[most - count[found[k]] + 1]++;
                for (int k = 1; k <= most; k++) tally[k] += tally[k - 1];
                for (int k = 0; k < many; k++) sorted[tally[most - count[found[k]]]++] = found[k];
                int[] swap = found; found = sorted; sorted = swap;
            }
            int lo = 0;
            while (lo < many) {
                int hi = lo, times = count[found[lo]];
                while (hi < many && count[found[hi]] == times) {
                    int p = found[hi], h = group[p], at = isa[p], to = h + size[h] - 1 - moved[h], q = sa[to];
                    sa[at] = q; sa[to] = p; isa[q] = at; isa[p] = to;
                    moved[h]++;
                    hi++;
                }
                for (int k = lo; k < hi; k++) {
                    int h = group[found[k]], m = moved[h];
                    if (m > 0) {
                        int fresh = h + size[h] - m;
                        moved[h] = 0;
                        if (fresh != h) {
                            size[h] -= m;
                            size[fresh] = m;
                            for (int x = fresh; x < fresh + m; x++) group[sa[x]] = fresh;
                        }
                    }
                }
                lo = hi;
            }
            for (int k = 0; k < many; k++) count[found[k]] = 0;
            end = g;
        }
        int[] out = isa, free = size;
        boolean[] put = new boolean[n];
        for (int i = 0; i < n; i++) free[i] = i;
        out[0] = n - 1;
        put[n - 1] = true;
        for (int i = 0; i < n; i++) {
            int j = out[i] - 1;
            while (j >= 0 && !put[j]) {
                out[free[group[j]]++] = j;
                put[j] = true;
                j = prev[j];
            }
        }
        return out;
    }

    public Object call(Object packed) {
        byte[] raw = (byte[]) packed;
        int width = WIDTH;
        java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap(raw);
        int n = in.getInt(), windows = 0, from = 4 + 12 * n, length = raw.length - from;
        int[] slot = new int[length + 1];
        long[] owner = new long[length + 1];
        for (int i = 0; i <= length; i++) slot[i] = -1;
        int at = 0;
        for (int s = 0; s < n; s++) {
            int m = in.getInt(4 + 4 * s);
            long id = in.getLong(4 + 4 * n + 8 * s);
            for (int o = 0; o + width <= m; o++) { slot[at + o] = windows++; owner[at + o] = id; }
            at += m;
        }
        int[] sa = suffixArray(raw, from, length);
        java.nio.ByteBuffer out = java.nio.ByteBuffer.allocate(8 * windows);
        int[] same = new int[windows + 1];
        int held = 0;
        long low = 0;
        for (int i = 0; i <= sa.length; i++) {
            int p = i < sa.length ? sa[i] : -1;
            if (p >= 0 && slot[p] < 0) continue;
            boolean equal = p >= 0 && held > 0;
            if (equal) {
                int a = from + p, b = from + same[0];
                for (int k = 0; k < width; k++) if (raw[a + k] != raw[b + k]) { equal = false; break; }
            }
            if (!equal) {
                for (int k = 0; k < held; k++) out.putLong(8 * slot[same[k]], low);
                held = 0;
            }
            if (p >= 0) {
                low = held == 0 || owner[p] < low ? owner[p] : low;
                same[held++] = p;
            }
        }
        return out.array();
    }
}
"""
