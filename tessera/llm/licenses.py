"""License scans (operator 2): MinHash bands over overlapping windows, then exact containment.

A text is words (letters and digits, lower case). Templates are put in size classes, and a class scans a
text in windows of twice its size that overlap by half. A window retrieves templates through a table of
bands: the minima of ``BANDS`` MinHashes of one row each, filed under band and value, so that a window is
looked up once however many templates there are. A template of a class has over half its size in shingles,
so a window that contains ``MIN_CONTAINED`` of it has a Jaccard similarity of at least 0.19 with it and is
missed with a chance under 0.81**BANDS = 4e-5. A copy lengthened by insertions may straddle windows; one of
them still holds half of what is left, at a similarity over 0.08 (a chance under 0.02), and the pair is
verified over the window widened by a size on each side: by the share of the template's five-word shingles
that it holds. Templates of up to ``WHOLE`` shingles can only be held whole and are looked up by their first.

All work is within a row: nothing is shuffled, and what tasks are given is the template list, whose
length is checked against ``MAX_TEMPLATES``. Defined results: a null or empty text matches nothing; a
text shorter than a window is one window; templates of fewer words than a shingle are one shingle and
match only as such; repeated rows and null ids give a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.common import python_batches, ship, texts, tidy

SHINGLE, BANDS, MIN_CONTAINED, MAX_TEMPLATES, WHOLE = 5, 48, 0.8, 5_000, 4
_WORDS = re.compile(r"[^\W_]+")
_MIX = np.random.default_rng(7).integers(1, 2**63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)

#: Notices of well-known public licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gfdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "odbl-1.0": "This database is made available under the Open Database License. Any rights in individual contents of the database are licensed under the Database Contents License.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "all-rights-reserved": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher.",
}
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _name in _CC.items():
    for _version, _port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES.setdefault("cc-by-4.0-line" if f"{_kind}-{_version}" == "by-4.0" else f"cc-{_kind}-{_version}-full", f"This work is licensed under a Creative Commons {_name} {_version} {_port} License.")
        TEMPLATES.setdefault(f"cc-{_kind}-{_version}-{'line' if f'{_kind}-{_version}' == 'by-nc-4.0' else 'short'}", f"Licensed under CC {_kind.upper()} {_version}.")
for _name in ("GNU Lesser General Public License", "GNU Affero General Public License", "Mozilla Public License", "Eclipse Public License", "European Union Public License", "Common Development and Distribution License", "Artistic License", "Open Software License", "Academic Free License", "Microsoft Public License"):
    _key = "".join(w[0] for w in _name.lower().split() if w not in ("and",))
    TEMPLATES[f"{_key}-line"] = f"This file is licensed under the terms of the {_name}"
    TEMPLATES[f"{_key}-release"] = f"This software is released under the {_name}, see the file LICENSE for details."
for _name in ("MIT License", "ISC License", "zlib License", "Apache License", "Boost Software License", "Unlicense", "BSD 2-Clause License", "BSD 3-Clause License", "Python Software Foundation License", "PostgreSQL License"):
    TEMPLATES[f"{_name.lower().replace(' ', '-')}-project"] = f"This project is licensed under the terms of the {_name}"


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class _Hashes(dict):
    """Hashes of words; forgotten when they are too many."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_word = _Hashes().__getitem__
_TOP = np.uint64(2**64 - 1)


def hashes(words: list[str]) -> np.ndarray:
    """A hash for each shingle of five words (of all words, if fewer)."""
    h = np.array(list(map(_word, words)), np.uint64)
    n = min(SHINGLE, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


class Scanner:
    def __init__(self, templates: dict[str, str]):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"over {MAX_TEMPLATES} templates")
        self.names = sorted(templates)
        words = [words_of(templates[n]) for n in self.names]
        self.shingles = [shingles(w) for w in words]
        classes: dict[int, list[int]] = {}
        #: Templates held whole or not at all, by the hash of their first shingle.
        first: dict[int, list[int]] = {}
        for k, s in enumerate(self.shingles):
            if 0 < len(s) <= WHOLE:
                first.setdefault(int(hashes(words[k])[0]), []).append(k)
            elif s:
                classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        self.first = _table([(h, k) for h, ks in first.items() for k in ks])
        #: For each size the table of its templates' bands.
        self.bands = {size: _table([(_filed(b, (hashes(words[k]) * m).min()), k) for k in ks for b, m in enumerate(_MIX)]) for size, ks in classes.items()}
        self.largest = max(classes, default=0)
        #: Shingles of a text held at once, a whole number of blocks of every class.
        self.stride = -(-4_096 // max(1, self.largest)) * max(1, self.largest)

    def retrieve(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first, last shingle) of windows, widened by a size on each side, that share a band with a template.

        Minima of blocks of a class are those of pairs of the next smaller class's, so all classes
        together cost about two passes over the hashes of a text, for all bands at once.
        """
        out: set[tuple[int, int, int]] = set()
        for at, k in _found(self.first, h):
            out.add((k, max(0, at - WHOLE), min(len(h), at + 2 * WHOLE)))
        for lo in range(0, len(h) if self.largest else 0, self.stride):
            part = h[lo : lo + self.stride + 2 * self.largest]
            low = part * _MIX[:, None]
            size = 1
            while True:
                if size in self.bands:
                    both = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                    wide = both.shape[1]
                    for place, k in _found(self.bands[size], _filed(_BAND, both).ravel()):
                        at = lo + place % wide * size
                        out.add((k, max(0, at - size), min(len(h), at + 3 * size)))
                if size >= self.largest:
                    break
                if low.shape[1] % 2:
                    low = np.hstack([low, np.full((BANDS, 1), _TOP)])
                low = np.minimum(low[:, ::2], low[:, 1::2])
                size *= 2
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(template, shingles held, shingles of the template, first word of the best window)."""
        words = words_of(text)
        h = hashes(words)
        if not len(h):
            return []
        best: dict[int, tuple[int, int]] = {}
        for k, lo, hi in sorted(self.retrieve(h)):
            want = self.shingles[k]
            n = len(want & shingles(words[lo : hi + SHINGLE - 1]))
            if n >= MIN_CONTAINED * len(want) and n > best.get(k, (0, 0))[0]:
                best[k] = n, lo
        return [(self.names[k], n, len(self.shingles[k]), at) for k, (n, at) in sorted(best.items())]


_BAND = np.arange(BANDS, dtype=np.uint64)[:, None]


def _filed(band, value):
    """A minimum as the table's key: the band in its low bits."""
    return np.uint64(value) >> np.uint64(6) << np.uint64(6) | np.uint64(band) if np.isscalar(value) else value >> np.uint64(6) << np.uint64(6) | band


def _table(rows: list[tuple[int, int]]) -> tuple[np.ndarray, dict[int, list[int]]]:
    """A bit for each top 16 bits that a key has, and templates by key."""
    by_key: dict[int, list[int]] = {}
    for key, k in rows:
        by_key.setdefault(int(key), []).append(k)
    bits = np.zeros(1 << 16, bool)
    bits[np.array(list(by_key), np.uint64) >> np.uint64(48)] = True
    return bits, by_key


def _found(table: tuple[np.ndarray, dict[int, list[int]]], keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, template) of keys that the table holds."""
    bits, by_key = table
    if not by_key:
        return
    at = np.flatnonzero(bits[keys >> np.uint64(48)])
    for place, key in zip(at.tolist(), keys[at].tolist(), strict=True):
        for k in by_key.get(key, ()):
            yield place, k


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, n_shared, n_template, first_word): each template that a text contains."""
    schema = "doc_id long, license string, n_shared long, n_template long, first_word long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for ids, part in python_batches(batches):
            rows = [(i, *found) for i, t in zip(ids, part, strict=True) for found in scanner.scan(t)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "license", "n_shared", "n_template", "first_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).transform(tidy, run, schema)
