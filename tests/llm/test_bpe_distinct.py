"""Ids by distinct chunks: against the tokenizers library, and no chunk's words encoded twice."""

import numpy as np
import pyarrow as pa

from tessera.llm import bpe
from tessera.llm.queries import word_bpe_path
from tests.llm import brute


def encoded(texts):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return [np.frombuffer(r, "<u4").tolist() for _, raw in bpe.encoded(word_bpe_path(), iter([batch])) for r in raw]


def test_odd_texts():
    texts = [f"a{chr(k)}B {chr(k)} {chr(k)}{chr(k)}c." for k in range(1, 256)]
    texts += ["", " ", "\n\t ", "x", "<|endoftext|>", "A<|endoftext|>b <|endoftext|><|im_end|> <|", "Привет, МИР!", "é İstanbul ﬁ", "漢字 かな", "a" * 500 + " " + "b1" * 40, "été" * 30, "it's we'LL 12,5 %"]
    texts += [" ".join(texts), *texts[::-1]]
    assert encoded(texts) == [brute.encode(t) for t in texts]
    assert encoded([]) == [] and encoded(["", " "]) == [[], []]


def test_each_word_is_encoded_once(monkeypatch):
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 8)) for _ in range(100_000)]
    asked = 0
    rank = bpe.WordBpe.rank

    def counted(self, left, right):
        nonlocal asked
        asked += left.size
        return rank(self, left, right)

    monkeypatch.setattr(bpe.WordBpe, "rank", counted)
    texts = [" ".join(words), ". ".join(words), ", ".join(words), "! ".join(words)]
    got = encoded(texts)
    assert asked <= 3 * sum(map(len, set(words)))  # one a pair at first, at most two a merge
    assert got[2] == brute.encode(texts[2])
