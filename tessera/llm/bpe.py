"""Byte-level BPE by backtracking from longest matches.

A piece's bytes are read as Latin-1, so that pyahocorasick, which takes text, finds every vocabulary entry in them. From
the longest entry at each place the encoder goes on as long as neighbours are compatible, that is as long as merging
their bytes alone would end in the same two tokens; if not, it falls back to the next shorter entry, or over the last token.
Compatibility depends on two tokens only and is memoised. The result is what applying the merges by rank gives, in time
linear in the piece. A piece that is an entry itself is that entry, as tiktoken has it.

Defined cases: a null text encodes as an empty one, to no tokens; equal rows get equal results; an empty table gives an
empty result; other columns pass through, but those named n_tokens, ids and decoded are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import parts

MEMO = 100_000  # pieces a worker remembers; then it starts anew


@cache
def tokens(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return [ranks.get(rank, b"") for rank in range(max(ranks) + 1)]


class Vocabulary(dict):
    """piece -> its ids as little-endian 32-bit integers, remembered as they are asked for."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.bytes_of = tokens(path)
        self.ranks = {token.decode("latin-1"): rank for rank, token in enumerate(self.bytes_of) if token}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if parts := self._halves(token, rank):
                self.parts[rank] = parts
                if len(token) > 1:
                    self.merged[parts] = rank
                self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs.clear()
        # Next shorter entry at the same place, among those that merging can reach.
        self.shorter = {rank: next((self.ranks[t] for k in range(len(token) - 1, 0, -1) if (t := token[:k]) in self.ranks and self.ranks[t] in self.parts), None) for token, rank in self.ranks.items() if rank in self.parts}

    def _halves(self, token: str, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; a single byte stands for itself; None if merging never gets there."""
        if len(token) == 1:
            return rank, rank
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
            if a is not None and b is not None and max(a, b) < rank and a in self.parts and b in self.parts and self.compatible(a, b):
                return a, b
        return None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves a and b as they are.

        Undo the later of the two last merges again and again: if any pair that meets at the border merges before what
        was undone, the border would have been crossed.
        """
        if (known := self.pairs.get((a, b))) is not None:
            return known
        left, right, bound = a, b, len(self.bytes_of)
        while True:
            if self.merged.get((left, right), bound) < bound:
                fine = False
                break
            single = self.parts[left][0] == left, self.parts[right][0] == right
            if all(single):
                fine = True
                break
            if single[1] or not single[0] and left > right:
                bound, left = left, self.parts[left][1]
            else:  # equal ranks merge from the left, so the pair at the border may come first
                bound, right = right + 1, self.parts[right][0]
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()
        self.pairs[a, b] = fine
        return fine

    def encode_piece(self, piece: str) -> list[int]:
        """piece: bytes as Latin-1."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest: list[int | None] = [None] * (len(piece) + 1)
        for end, (rank, size) in self.automaton.iter(piece):
            longest[end + 1 - size] = rank  # ends come in order, so the last is the longest
        ids: list[int] = []
        at, here, blocked = 0, longest[0], bytearray(len(piece) + 1)
        while here is not None:
            end = at + len(self.bytes_of[here])
            if not blocked[end] and (not ids or self.compatible(ids[-1], here)):
                ids.append(here)
                at, here = end, longest[end]
            elif (here := self.shorter[here]) is None:
                blocked[at] = 1
                here = ids.pop()
                at -= len(self.bytes_of[here])
                # `here` itself ends at a blocked place, so the next turn takes a shorter one.
        return ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = np.array(self.encode_piece(piece.encode("utf-8").decode("latin-1")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@cache
def _loaded(path: str, pattern: str) -> tuple[Vocabulary, regex.Pattern]:
    return Vocabulary(path), regex.compile(pattern)


def encode_text(text: str | None, path: str, pattern: str) -> bytes:
    vocabulary, pieces = _loaded(path, pattern)
    return b"".join(map(vocabulary.__getitem__, pieces.findall(text or "")))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", drop_text: bool = True) -> DataFrame:
    """docs with its text encoded: ids (little-endian 32-bit integers, binary) and n_tokens; path must be readable on every executor."""
    columns = docs.columns
    names, at = [c for c in columns if not (drop_text and c == text) and c not in ("n_tokens", "ids")], columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, at):
                ids = [encode_text(t.as_py(), path, pattern) for t in some.column(at)]
                kept = [c for c, name in zip(some.columns, columns, strict=True) if name in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [*names, "n_tokens", "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.mapInArrow(of, f"{fields}{', ' * bool(fields)}n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with column decoded, the bytes that its ids stand for."""
    encoded = encoded.drop("decoded")
    names, at = encoded.columns, encoded.columns.index("ids")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = tokens(path)  # all that decoding needs
        for batch in batches:
            for some in parts(batch, at):
                texts = [b"".join([bytes_of[i] for i in np.frombuffer(x.as_py() or b"", "<u4").tolist()]) for x in some.column(at)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(of, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs.select(id_col, text), path, pattern, text), path)
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
