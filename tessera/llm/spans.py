"""Substring dedup by sliding spans of sentences.

A text is cut into units: sentences (ended by . ! ? or a line break), cut again after words chosen by their own hash, one in
`CUT`. As the words decide, a passage is cut alike wherever it stands, also in the middle of another sentence. From every
unit the shortest run of at least `RUN` units and `LEAST` words is hashed; the hashes are counted over all texts, with sums
on the map side; of a run found more than once, the first place (smallest doc_id, then position) stays, and every unit that
any other place covers is removed.

Nothing bounds the gap between cuts, so `WINDOW` words may hold no run that begins after one of their own cuts and ends before
their last word. With `windows` every such stretch is hashed as it stands and counted with the runs, and its later places lose
just its words: whatever stands between two cuts, a passage of `WINDOW` words that comes again, with the same line breaks, is found.

Defined cases: null and empty texts have no units and come back empty; texts with fewer than RUN units or LEAST words have no
run and stay as they are; a unit of which some words are removed counts as removed; rows with equal doc_id and text are one place and are
treated alike; different texts under one doc_id, or without any, are places of their own, those without a doc_id after all others; case and the kind of white space don't count; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import parts
from tessera.llm.shingles import range_hashes
from tessera.shared import materialise

RUN, LEAST, CUT, WINDOW = 3, 16, 6, 50
MEMO = 400_000
LAST = 2**63 - 1
_APART = np.uint64(0x5851F42D4C957F2D)  # keeps the hashes of windows from those of runs of the same words
_UNITS = 32  # more than the units of a run, as each has a word at least and a run ends once it has LEAST words and RUN units
_TOKEN = re.compile(r"\s*\S+\s*|\s+")


class _Codes(dict):
    """A word with the white space around it -> the hash of its lower-cased form; the lowest bits tell whether a sentence ends there and whether its hash cuts."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        bare = token.strip().lower()
        code = int.from_bytes(blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        self[token] = found = code & ~3 | (code % CUT == 0) << 1 | (bare.endswith((".", "!", "?")) or "\n" in token)
        return found


_CODES = _Codes()


def cut(text: str | None, cuts: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words with their white space, their hashes, where units begin and, last, where the text ends)."""
    tokens = _TOKEN.findall(text or "")
    codes = np.fromiter(map(_CODES.__getitem__, tokens), np.uint64, len(tokens))
    bounds = np.flatnonzero(codes & np.uint64(3 if cuts else 1)) + 1
    last = [] if len(bounds) and bounds[-1] == len(tokens) or not tokens else [len(tokens)]
    return tokens, codes >> np.uint64(2), np.concatenate([[0], bounds, last]).astype(np.int64)


def runs_of(codes: np.ndarray, bounds: np.ndarray, windows: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the run from each unit that has one and then, if asked for, of each window without a run.

    A run's place is its unit times `_UNITS` plus its units, a window's its first word times `_UNITS`.
    """
    n, words = len(bounds) - 1, len(codes)
    first = np.arange(max(0, n - RUN + 1))
    last = np.maximum(first + RUN, np.searchsorted(bounds, bounds[first] + LEAST))
    first, last = first[last <= n], last[last <= n]
    if not windows:
        return range_hashes(codes, bounds[first], bounds[last]).view(np.int64), first * _UNITS + (last - first)
    ends = np.full(n + 1, np.iinfo(np.int64).max)
    ends[first] = bounds[last]
    at = np.arange(max(0, words - WINDOW + 1))
    at = at[np.repeat(ends[1:], np.diff(bounds))[: len(at)] >= at + WINDOW]  # where the first run after the window's first word ends
    hashes = range_hashes(codes, np.concatenate([bounds[first], at]), np.concatenate([bounds[last], at + WINDOW]))
    hashes[len(first) :] ^= _APART
    return hashes.view(np.int64), np.concatenate([first * _UNITS + (last - first), at * _UNITS])


def _runs(windows: bool, cuts: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 2, most_rows=200):
                found = [runs_of(*cut(t.as_py(), cuts)[1:], windows) for t in some.column(2)]
                each = [len(h) for h, _ in found]
                d, k = (np.repeat(c.to_numpy(zero_copy_only=False), each) for c in some.columns[:2])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found])), pa.array(d), pa.array(k), pa.array(np.concatenate([p for _, p in found]))], ["h", "d", "k", "place"])

    return of


def _without(cuts: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 1, most_rows=200):
                out = [_left(text, covers, cuts) for text, covers in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string()), strict=True))], ["doc_id", "n_removed", "text"])

    return of


def _left(text: str | None, covers: list[int] | None, cuts: bool) -> tuple[int, str]:
    """(units removed, text left) of a text in which runs and windows at these places go."""
    if not covers:
        return 0, text or ""
    tokens, _, bounds = cut(text, cuts)
    gone = np.zeros(len(tokens) + 1, np.int64)
    first, size = np.divmod(np.array(covers, np.int64), _UNITS)
    window, run = first[size == 0], size > 0
    np.add.at(gone, np.concatenate([bounds[first[run]], window]), 1)
    np.add.at(gone, np.concatenate([bounds[(first + size)[run]], window + WINDOW]), -1)
    gone = np.cumsum(gone)[:-1] > 0
    return int(np.logical_or.reduceat(gone, bounds[:-1]).sum()), "".join(compress(tokens, ~gone))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", windows: bool = False, cuts: bool = True) -> DataFrame:
    """Per row: doc_id, n_removed (units), and text without the units that a repeated run covers and, with `windows`, without the words of repeated windows.

    Without `cuts`, units are whole sentences and nothing smaller is found or removed.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("k"), "text")  # d and k: the row, by id and content
    runs = placed.select("d", "k", "text").mapInArrow(_runs(windows, cuts), "h long, d long, k long, place long")
    repeated = materialise(runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
    found = materialise(runs.join(repeated, "h", "left_semi"), "places")
    # Written, so that the join below it reads plain shuffles and AQE can split a run that very many texts hold.
    first = materialise(found.groupBy("h").agg(F.min(F.struct("d", "k", "place")).alias("first")), "first")
    later = found.join(first, "h").where("d <> first.d or k <> first.k or place <> first.place")
    places = materialise(later.groupBy("d", "k").agg(F.collect_set("place").alias("places")), "repeats")  # at most a text's own units and words
    marked = placed.join(places, ["d", "k"], "left")
    return marked.select("doc_id", "text", "places").mapInArrow(_without(cuts), "doc_id long, n_removed long, text string")
