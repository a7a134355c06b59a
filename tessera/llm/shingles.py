"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), 200_000  # bytes of text that are hashed at a time; a longer word comes alone
_KEPT = 500_000  # powers that a worker keeps
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    return [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))]) for base in (_ODD, _INVERSE)]


@cache
def _kept_powers() -> list[np.ndarray]:
    return _powers(_KEPT)


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd base modulo 2 ** 64, and of its inverse."""
    return [x[:n] for x in (_kept_powers() if n <= _KEPT else _powers(n))]


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each pair; equal stretches of codes have equal hashes wherever they stand."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _hash_words(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some bytes, and where each word begins."""
    word = np.concatenate([[False], _IS_WORD[joined], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    return range_hashes(_LOWER[joined].astype(np.uint64) + np.uint64(1), starts, ends), starts


def _of_long(text: bytes) -> np.ndarray:
    """Word hashes of one text, in steps that end at white space."""
    out, at = [], 0
    while at < len(text):
        gap = _SPACE.search(text, at + _STEP)
        stop = gap.end() if gap else len(text)
        out.append(_hash_words(np.frombuffer(text, np.uint8, stop - at, at))[0])
        at = stop
    return np.concatenate(out)


def _fold(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
    """Hash of the `width` words from each of the first n places."""
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = acc * _ODD + hashes[k : k + n]
        acc ^= acc >> np.uint64(29)
    return mix(acc)


def _set_of(hashes: np.ndarray, words: int) -> np.ndarray:
    if len(hashes) >= words:
        return np.unique(_fold(hashes, len(hashes) - words + 1, words))
    # the whole sequence as one shingle; none without words
    return _fold(hashes, 1, len(hashes)) if len(hashes) else np.zeros(0, np.uint64)


def _of_chunk(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    hashes, starts = _hash_words(np.frombuffer(b" ".join([*texts, b""]), np.uint8))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])).tolist()
    all_of = _fold(hashes, max(0, len(hashes) - words + 1), words)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(all_of[a : b - words + 1]) if b - a >= words else _set_of(hashes[a:b], words)


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles. Words are runs without ASCII white space, A-Z lowered."""
    chunk: list[bytes] = []
    held = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held + len(data) > _STEP and chunk:
            yield from _of_chunk(chunk, words)
            chunk, held = [], 0
        if len(data) > _STEP:
            yield _set_of(_of_long(data), words)
        else:
            chunk.append(data)
            held += len(data) + 1
    if chunk:
        yield from _of_chunk(chunk, words)
