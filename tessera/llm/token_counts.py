"""Token counts (operator 7) under a unigram vocabulary, by dynamic programming shared in a trie.

Distinct pre-tokens (a word mark and a word) are inserted in a trie. A node holds the best score of
splitting the string that leads to it into pieces, and the fewest pieces that reach it, so a prefix that
many words share is computed once; a word's count is that of the node where it ends.

The trie stops growing at ``NODES`` nodes and at ``DEPTH`` characters of a word: what is left of a longer
word goes on from the node reached with a window of scores that the longest piece bounds, so no text, word
or number of words takes more memory. Trie and remembered counts are dropped when they are full; there is no
shuffle. A character that is no piece counts as its UTF-8 bytes, at a score
below that of any piece. Defined results: a null or empty text has no tokens; repeated rows and null ids
are counted as they come; words are separated by ASCII white space only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import python_batches, ship, texts, tidy

MARK, NODES, WORDS, UNKNOWN = "▁", 1_500_000, 500_000, -10.0
#: Characters of a word whose states are kept in the trie; bytes of the longest word whose count is remembered.
DEPTH = 64
#: Bytes of a text split into words at once.
SLICE = 1 << 22


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}


class ForwardTrie:
    def __init__(self, scores: dict[str, float]):
        #: Every end of a piece; None unless it is a piece itself.
        self.ends: dict[str, float | None] = {}
        for piece in scores:
            for k in range(len(piece)):
                self.ends.setdefault(piece[k:], None)
        self.ends.update(scores)
        self.span = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) + UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Pieces of the best split of a word: the highest score, then the fewest pieces."""
        if len(self.score) > NODES:
            self.clear()
        node, path, step = 0, [0], self.next
        for d, char in enumerate(word[:DEPTH], 1):
            key = node << 21 | ord(char)
            if (child := step.get(key)) is None:
                child = step[key] = self.forward(word, d, path)
            path.append(child)
            node = child
        if len(word) <= DEPTH:
            return self.count[node]
        return self.beyond(word, path)

    def beyond(self, word: str, path: list[int]) -> int:
        """The count of a word longer than DEPTH: its last scores only, in a window as long as the longest piece."""
        ends, span = self.ends, self.span
        last = deque(((self.score[n], self.count[n]) for n in path[-span:]), maxlen=span)
        for d in range(DEPTH + 1, len(word) + 1):
            char = word[d - 1]
            best, fewest = last[-1][0] + self.unknown, last[-1][1] + len(char.encode("utf-8", "surrogatepass"))
            for n in range(1, min(span, len(last)) + 1):
                part = word[d - n : d]
                value = ends.get(part, 0)
                if value == 0 and part not in ends:
                    break
                if value is not None:
                    total, pieces = last[-n][0] + value, last[-n][1] + 1
                    if total > best or total == best and pieces < fewest:
                        best, fewest = total, pieces
            last.append((best, fewest))
        return last[-1][1]

    def forward(self, word: str, d: int, path: list[int]) -> int:
        ends, score, count = self.ends, self.score, self.count
        back = path[d - 1]
        char = word[d - 1]
        best, fewest = score[back] + self.unknown, count[back] + len(char.encode("utf-8", "surrogatepass"))
        for lo in range(d - 1, -1, -1):
            value = ends.get(word[lo:d], 0)
            if value == 0 and word[lo:d] not in ends:
                break
            if value is not None:
                back = path[lo]
                total, pieces = score[back] + value, count[back] + 1
                if total > best or total == best and pieces < fewest:
                    best, fewest = total, pieces
        score.append(best)
        count.append(fewest)
        return len(score) - 1


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about SLICE bytes, cut at spaces only."""
    lo = 0
    while len(raw) - lo > SLICE and (hi := raw.find(b" ", lo + SLICE)) >= 0:
        yield raw[lo:hi]
        lo = hi
    yield raw[lo:] if lo else raw


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(vocabulary(path))
        known: dict[bytes, int] = {}
        for ids, part in python_batches(batches):
            words, tokens = [], []
            for text in part:
                n = total = 0
                for piece in _slices(text.encode("utf-8", "surrogatepass")):
                    split = piece.split()
                    n += len(split)
                    for w in {w for w in split if w not in known and len(w) <= DEPTH}:
                        known[w] = trie.tokens(MARK + w.decode("utf-8", "surrogatepass"))
                    total += sum([known[w] if len(w) <= DEPTH else trie.tokens(MARK + w.decode("utf-8", "surrogatepass")) for w in split])
                    if len(known) > WORDS:
                        known.clear()
                words.append(n)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, words, tokens)], ["doc_id", "n_words", "n_tokens"])

    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).transform(tidy, run, "doc_id long, n_words long, n_tokens long")
