"""Token counts under a unigram model by dynamic programming over a shared trie.

The pieces of a vocabulary carry log-probabilities; a pre-token's segmentation is that of the largest total, with fewer
tokens on a tie. The best total of a prefix depends on the prefix alone, so a worker puts its distinct pre-tokens in a
trie and scores each node once, however many pre-tokens pass through it; the node where one ends keeps its count. Counts
of a text are then lookups. Nothing is shuffled.

A trie that has grown past `NODES` is dropped and begun anew: memory stays bounded and no result changes.

Defined cases: null and empty texts have no tokens; characters that the vocabulary lacks count one token for each UTF-8
byte; equal rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = 400_000
BYTE_LOG = -20.0  # log-probability of a byte that stands in for part of an unknown character
PRE_TOKEN = r" ?[^\s]+|\s"
SPACE_MARK = "▁"


@cache
def pieces(path: str) -> dict[str, float]:
    """Piece -> log-probability by Zipf's law over the vocabulary's own order, special and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (k + 1) for k in range(len(plain)))
    return {p: -log((k + 1) * total) for k, p in enumerate(plain)}


class Trie:
    """Nodes as parallel lists; below[node] maps a character to a node."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        #: Every end of a piece -> the piece's log-probability, None if the end is no piece itself: what a node's own end is looked up in,
        #: from its last character on and no further than some piece goes.
        self.ends: dict[str, float | None] = {p[k:]: None for p in vocabulary for k in range(1, len(p))} | vocabulary
        self.clear()

    def clear(self) -> None:
        self.below: list[dict[str, int]] = [{}]
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a pre-token."""
        if (known := self.terminal.get(word)) is not None:
            return known
        if len(self.score) > NODES or len(self.terminal) > NODES:
            self.clear()
        if len(word) > 256:  # kept out of the trie: its nodes would not be shared
            keep = self.below, self.score, self.tokens
            self.below, self.score, self.tokens = [{}], [0.0], [0]
            n = self._walk(word)
            self.below, self.score, self.tokens = keep
            return n
        n = self.terminal[word] = self._walk(word)
        return n

    def _walk(self, word: str) -> int:
        path, ends, score, tokens = [0], self.ends, self.score, self.tokens
        for end, c in enumerate(word, 1):
            at = self.below[path[-1]].get(c)
            if at is None:
                size = len(c.encode("utf-8"))
                best, fewest = score[path[-1]] + BYTE_LOG * size, tokens[path[-1]] + size
                for start in range(end - 1, -1, -1):
                    p = ends.get(word[start:end], 0)
                    if p:
                        s, n = score[path[start]] + p, tokens[path[start]] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                    elif p == 0:  # no piece ends so
                        break
                at = self.below[path[-1]][c] = len(score)
                self.below.append({})
                score.append(best)
                tokens.append(fewest)
            path.append(at)
        return tokens[path[-1]]


@cache
def _trie(path: str) -> tuple[Trie, regex.Pattern]:
    return Trie(pieces(path)), regex.compile(PRE_TOKEN)


def count_text(text: str, path: str) -> int:
    trie, split = _trie(path)
    return sum(n * trie.count(word.replace(" ", SPACE_MARK)) for word, n in Counter(split.findall(text)).items())


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens. path: a sentencepiece model, readable on every executor."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count_text(t.as_py() or "", path) for t in batch.column(1)], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(of, "doc_id long, n_tokens long")
