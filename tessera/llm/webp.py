"""Lossless WebP (VP8L), both ways, for byte columns stored as images.

The decoder takes any lossless file: prefix codes (simple and normal, in groups chosen by an entropy image), back-references
with the short distance map, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.
The encoder picks, by estimated size, a palette, a predictor per image, subtract-green, a cross-colour factor or none,
finds back-references of three pixels and more, uses a colour cache where pixels recur, and writes one group of prefix codes.

Bytes become pixels four at a time, in the order red, green, blue, alpha, rows of `WIDTH` pixels; more rows than a file
may have go to further files, one after the other.

Defined cases: a null text is an empty one; every payload is padded with 255 to a positive multiple of a row; equal texts
give equal files; an empty table gives an empty result; other columns are not read; damaged files raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import parts

WIDTH, MOST_ROWS, ROW = 144, 16_384, 576
AHEAD = 1 << 13  # bits that the decoder reads ahead
LENGTHS, CACHE_BITS = 24, 10
SMOOTH = 24  # mean difference to the pixel before, or of red and blue to green, up to which transforms are weighed; letters differ by more
ALIKE = 12  # channels whose means differ by less share a prefix code
SHORT = 9  # bits of a code that the encoder makes, or one more than its number of symbols needs; the format and the decoder have 15
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Fixed values of the format: the order of code-length codes, and the places that short distance codes stand for (x to the left, y up).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_HASH = np.uint32(0x1E35A7BD)
BLACK = 0xFF000000
_SHIFTS = 8, 16, 0, 24, 0  # where the symbols of the codes for green, red, blue, alpha and distance go
_SAMPLES = np.arange(256)
_FIRST_LENGTH, _FIRST_CACHED = 256 << 6, 256 + LENGTHS << 6  # where lengths and cache keys begin in entries of the code for green


# Prefix codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a complete prefix code, at most `most` bits; a lone symbol gets 1 here and 0 bits when used.

    Each symbol's information rounded up; what the code then has to spare goes to those that were rounded up the most.
    """
    lengths = np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0]
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    want = np.log2(counts.sum() / counts[used])
    short = np.clip(np.ceil(want), 1, most).astype(np.int64)
    spare = (1 << most) - int((1 << (most - short)).sum())
    order, depth = np.argsort(want - short).tolist(), short.tolist()
    while spare < 0:  # too many codes were cut to `most`: lengthen the longest of the others
        k = max((k for k in order if depth[k] < most), key=depth.__getitem__)
        depth[k] += 1
        spare += 1 << (most - depth[k])
    while spare:
        for k in order:
            if (takes := 1 << (most - depth[k])) <= spare:
                depth[k] -= 1
                spare -= takes
                if not spare:
                    break
    lengths[used] = depth
    return lengths


@lru_cache(16)
def _mirror(n: int) -> np.ndarray:
    """n-bit numbers, bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols in the order of their codes, how much of 2 ** most each code takes, most)."""
    used = lengths.nonzero()[0]
    used = used[np.argsort(lengths[used], kind="stable")]
    most = int(lengths[used[-1]]) if len(used) else 0
    return used, np.int64(1) << (most - lengths[used]), most


def _reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    used, takes, most = _in_order(lengths)
    codes[used] = _mirror(most)[np.cumsum(takes) - takes] if len(used) > 1 else 0
    return codes


@lru_cache(64)
def _table(packed: bytes) -> tuple[np.ndarray, int]:
    """(entries by the next bits, their mask): the symbol, then six bits for its length. packed: a length per symbol, as bytes."""
    lengths = np.frombuffer(packed, np.uint8).astype(np.int64)
    used, takes, most = _in_order(lengths)
    if len(used) < 2:
        return (used[:1] if len(used) else np.zeros(1, np.int64)) << 6, 0
    if int(takes.sum()) != 1 << most:
        raise ValueError("incomplete prefix code")
    return np.repeat(used << 6 | lengths[used], takes)[_mirror(most)], (1 << most) - 1


def _prefix_of(value: np.ndarray) -> np.ndarray:
    """Rows of prefix code, number of extra bits and extra bits of values from 1 on."""
    v = value.astype(np.int64) - 1
    top = np.zeros(len(v), np.int64)
    big = v >= 4
    top[big] = np.floor(np.log2(v[big])).astype(np.int64)
    extra = np.where(big, top - 1, 0)
    return np.stack([np.where(big, 2 * top + ((v >> np.maximum(extra, 0)) & 1), v), extra, np.where(big, v & ((1 << extra) - 1), 0)])


_PREFIXES = _prefix_of(np.arange(1, 1 << 14))


def _prefix(value: np.ndarray) -> np.ndarray:
    return _prefix_of(value) if len(value) and value.max() > _PREFIXES.shape[1] else _PREFIXES[:, value - 1]


# Transforms, on rows of 32-bit pixels (alpha, red, green, blue from the top) and on their channels as bytes, blue first


def _bytes(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4").reshape(channels.shape[:-1])


def _cross(factor: int, by: np.ndarray) -> np.ndarray:
    """What a channel owes to another: the signed product, shifted."""
    return ((np.int32(factor if factor < 128 else factor - 256) * by.view(np.int8).astype(np.int32)) >> 5).astype(np.uint8)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int32) + b) >> 1).astype(np.uint8)


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    guess = left.astype(np.int32) + top - corner
    return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top


_clip = lambda x: np.clip(x, 0, 255).astype(np.uint8)
#: Modes that read the row above only work on stretches; those that read the left pixel go pixel by pixel, but for mode 1, a running sum.
_ABOVE: dict[int, Callable] = {2: lambda t, tr, tl: t, 3: lambda t, tr, tl: tr, 4: lambda t, tr, tl: tl, 8: lambda t, tr, tl: _half(tl, t), 9: lambda t, tr, tl: _half(t, tr)}
_BESIDE: dict[int, Callable] = {
    5: lambda le, t, tr, tl: _half(_half(le, tr), t),
    6: lambda le, t, tr, tl: _half(le, tl),
    7: lambda le, t, tr, tl: _half(le, t),
    10: lambda le, t, tr, tl: _half(_half(le, tl), _half(t, tr)),
    11: lambda le, t, tr, tl: _select(le, t, tl),
    12: lambda le, t, tr, tl: _clip(le.astype(np.int32) + t - tl),
    13: lambda le, t, tr, tl: _clip((h := _half(le, t).astype(np.int32)) + (h - tl) // 2 + (((h - tl) < 0) & ((h - tl) % 2 != 0))),
}


def _unpredict(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    out = _bytes(pixels).copy()
    height, width = pixels.shape
    out[0, 0] = (out[0, 0].astype(np.int32) + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] += above[0]
        for block in range(-(-width // (1 << bits))):
            a, b = max(1, block << bits), min(width, (block + 1) << bits)
            if a >= b:
                continue
            mode = int(modes[y >> bits, block])
            if mode == 1:
                row[a:b] = np.cumsum(np.concatenate([row[a - 1 : a], row[a:b]]), axis=0, dtype=np.uint8)[1:]
            elif mode in (0, 14, 15):
                row[a:b, 3] += np.uint8(255)
            else:
                right = np.concatenate([above[a + 1 : b + 1], row[:1]])[: b - a]
                if mode in _ABOVE:
                    row[a:b] += _ABOVE[mode](above[a:b], right, above[a - 1 : b - 1])
                else:
                    rule = _BESIDE[mode]
                    for x in range(a, b):
                        row[x] += rule(row[x - 1], above[x], right[x - a], above[x - 1])
    return _pixels(out)


def _uncross(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    out = _bytes(pixels).copy()
    for by in range(factors.shape[0]):
        for bx in range(factors.shape[1]):
            f = int(factors[by, bx])
            part = out[by << bits : (by + 1) << bits, bx << bits : (bx + 1) << bits]
            green = np.ascontiguousarray(part[..., 1])
            part[..., 2] += _cross(f & 255, green)
            part[..., 0] += _cross(f >> 8 & 255, green)
            part[..., 0] += _cross(f >> 16 & 255, np.ascontiguousarray(part[..., 2]))
    return _pixels(out)


def _ungreen(pixels: np.ndarray) -> np.ndarray:
    out = _bytes(pixels).copy()
    out[..., 2] += out[..., 1]
    out[..., 0] += out[..., 1]
    return _pixels(out)


def _unindex(pixels: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    index = (pixels >> 8) & 255
    if bits:
        each = 8 >> bits
        index = ((index[..., None] >> (np.arange(1 << bits) * each).astype(np.uint32)) & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(palette)] = palette
    return whole[index]


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# Reading


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data = data + bytes(32)
        self.eight = np.ndarray((len(data) + 24,), "<u8", self.data, strides=(1,))  # the eight bytes from each place
        self.words = self.eight.tolist()
        self.at, self.end = 0, 8 * len(data)

    def bits(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("file ends early")
        out = (self.words[self.at >> 3] >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: tuple[np.ndarray, int]) -> int:
        e = int(table[0][(self.words[self.at >> 3] >> (self.at & 7)) & table[1]])
        self.at += e & 63
        return e >> 6

    def _span(self, at: int, n: int) -> int:
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def codes(self, sizes: tuple[int, ...]) -> list[bytes]:
        """Lengths per symbol of one code after the other. Equal bits give equal codes: such a code is not read again."""
        out: list[bytes] = []
        last = None
        for size in sizes:
            if last and last[0] == size and self.at + last[2] <= self.end and self._span(self.at, last[2]) == last[1]:
                self.at += last[2]
                out.append(out[-1])
                continue
            start = self.at
            out.append(self.code(size))
            last = size, self._span(start, self.at - start), self.at - start
        return out

    def code(self, size: int) -> bytes:
        lengths = bytearray(size)
        if self.bits(1):
            two, wide = self.bits(1), self.bits(1)
            lengths[self.bits(8 if wide else 1)] = 1
            if two:
                lengths[self.bits(8)] = 1
            return bytes(lengths)
        first = bytearray(19)
        for k in LENGTH_ORDER[: 4 + self.bits(4)]:
            first[k] = self.bits(3)
        entries, mask = _table(bytes(first))
        entries, words = entries.tolist(), self.words
        left = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else size
        at, last, p = 0, 8, self.at
        while at < size and left and p <= self.end:
            left -= 1
            v = words[p >> 3] >> (p & 7)
            e = entries[v & mask]
            s, v = e >> 6, v >> (e & 63)
            p += e & 63
            if s < 16:
                lengths[at] = s
                at, last = at + 1, s or last
            else:
                n = 3 + (v & 3) if s == 16 else 3 + (v & 7) if s == 17 else 11 + (v & 127)
                p += (2, 3, 7)[s - 16]
                if at + n > size:
                    raise ValueError("too many code lengths")
                if s == 16:
                    lengths[at : at + n] = bytes([last]) * n
                at += n
        self.at = p
        if p > self.end:
            raise ValueError("file ends early")
        return bytes(lengths)

    def value(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.bits(extra) + 1

    def image(self, width: int, height: int, top: bool) -> np.ndarray:
        cache_bits = self.bits(4) if self.bits(1) else 0
        groups_at, group_bits, n_groups = None, 0, 1
        if top and self.bits(1):
            group_bits = self.bits(3) + 2
            groups_at = (self.image(-(-width // (1 << group_bits)), -(-height // (1 << group_bits)), False) >> 8 & 0xFFFF).tolist()
            n_groups = max(map(max, groups_at)) + 1
        sizes = 256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40
        packed = [self.codes(sizes) for _ in range(n_groups)]
        groups = [[_table(p) for p in g] for g in packed]
        pixels = self._pixels(width, height, cache_bits, groups, groups_at, group_bits)
        if self.at > self.end:
            raise ValueError("file ends early")
        return np.array(pixels, np.uint32).reshape(height, width)

    def _ahead(self, start: int, size: int, group: list) -> tuple[np.ndarray, np.ndarray, memoryview]:
        """Where a literal or a cached pixel ends that begins at one of `size` places, start being the first of a byte.

        (The bits from each place on, the entry for green, the place after; -1: a back-reference.)
        """
        words = self.eight[start >> 3 : (start >> 3) + (size >> 3) + 9]
        v = (words[:, None] >> np.arange(8, dtype=np.uint64)).ravel().view(np.int64)
        green = group[0][0].take(v[:size] & group[0][1])
        after = np.arange(size) + (green & 63)
        last = steps = None
        for entries, mask in group[1:4]:
            if not mask:
                continue
            if entries is not last:  # equal codes have one table
                last, steps = entries, (entries & 63).take(v & mask)
            after += steps.take(after)
        after[green >= _FIRST_LENGTH] = -1
        if len(cached := (green >= _FIRST_CACHED).nonzero()[0]):
            after[cached] = cached + (green[cached] & 63)
        return v, green, memoryview(after)

    def _literals(self, places: list[int], v: np.ndarray, green: np.ndarray, group: list, cache: list[int] | None, shift: int) -> list[int]:
        """The pixels that begin at these places; the cache takes them up."""
        at = np.array(places)
        first = found = green.take(at)
        total = (found >> 6) << _SHIFTS[0]
        for (entries, mask), up in zip(group[1:4], _SHIFTS[1:4], strict=True):
            at += found & 63
            found = entries.take(v.take(at) & mask) if mask else entries[:1]
            total += (found >> 6) << up
        out = total.tolist()
        if cache is not None:
            hits = first >= _FIRST_CACHED
            keys = np.where(hits, (first >> 6) - (256 + LENGTHS), ((total * 0x1E35A7BD) & 0xFFFFFFFF) >> shift)
            for i, (key, hit) in enumerate(zip(keys.tolist(), hits.tolist(), strict=True)):
                if not hit:
                    cache[key] = out[i]
                elif x := cache[key]:
                    out[i] = x
                else:  # of a slot not yet written: black without alpha, whose own slot is the first
                    out[i] = cache[0] = 0
        return out

    def _pixels(self, width: int, height: int, cache_bits: int, groups: list, groups_at: list | None, group_bits: int) -> list[int]:
        p, n = self.at, width * height
        out: list[int] = []
        cache, shift, cached = [0] * (1 << cache_bits) if cache_bits else None, 32 - cache_bits, 0
        i = group = 0
        known = start = size = -1  # what was read ahead: the group, the first place, the number of places
        while i < n:
            stop = n
            if groups_at is not None:
                y, x = divmod(i, width)
                stop = i - x + min(width, ((x >> group_bits) + 1) << group_bits)
                group = groups_at[y >> group_bits][x >> group_bits]
            if known != group or not start <= p < start + size:
                if p > self.end:
                    raise ValueError("file ends early")
                known, start = group, p & -8
                size = min(AHEAD, ((self.end - start) | 7) + 1, 64 * (n - i) + 8)
                v, green, after = self._ahead(start, size, groups[group])
            k, places = p - start, []
            add = places.append
            for i in range(i, stop):
                if k >= size or (j := after[k]) < 0:
                    break
                add(k)
                k = j
            else:
                i = stop
            if places:
                if cache is not None:
                    for x in out[cached:]:
                        cache[((x * 0x1E35A7BD) & 0xFFFFFFFF) >> shift] = x
                out += self._literals(places, v, green, groups[group], cache, shift)
                cached = len(out)
            p = start + k
            if i == stop or k >= size:
                continue
            e = int(green[k])
            self.at = p + (e & 63)
            length = self.value((e >> 6) - 256)
            distance = self.value(self.symbol(groups[group][4]))
            p = self.at
            if distance > 120:
                distance -= 120
            else:
                x, y = NEAR[distance - 1]
                distance = max(1, x + y * width)
            if distance > i or i + length > n:
                raise ValueError("back-reference out of the image")
            if distance >= length:
                out += out[i - distance : i - distance + length]
            else:
                out += (out[i - distance :] * (length // distance + 1))[:length]
            i += length
        self.at = p
        return out


def decode(data: bytes) -> np.ndarray:
    """One file's pixels as a (height, width, 4) array of red, green, blue and alpha samples."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    read = _Reader(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height, _, version = read.bits(14) + 1, read.bits(14) + 1, read.bits(1), read.bits(3)
    if version:
        raise ValueError("unknown version")
    undo: list[Callable[[np.ndarray], np.ndarray]] = []
    seen, at_width = set(), width
    while read.bits(1):
        kind = read.bits(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            bits = read.bits(3) + 2
            side = read.image(-(-at_width // (1 << bits)), -(-height // (1 << bits)), False)
            undo.append((lambda x, m=side >> 8 & 15, b=bits: _unpredict(x, m, b)) if kind == PREDICTOR else (lambda x, f=side, b=bits: _uncross(x, f, b)))
        elif kind == GREEN:
            undo.append(_ungreen)
        else:
            palette = _pixels(np.cumsum(_bytes(read.image(read.bits(8) + 1, 1, False)[0]), axis=0, dtype=np.uint8))
            bits, full = _bundle(len(palette)), at_width
            undo.append(lambda x, p=palette, b=bits, w=full: _unindex(x, p, b, w))
            at_width = -(-at_width // (1 << bits))
    pixels = read.image(at_width, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    return _bytes(pixels)[..., [2, 1, 0, 3]]


# Writing


def _length_code(often: list[int]) -> tuple[int, int, list[int], list[int]]:
    """A prefix code for code lengths: (the fields that announce it, their bits, lengths as used, codes)."""
    first = code_lengths(np.array(often), 7).tolist()
    n = max(k for k, s in enumerate(LENGTH_ORDER) if first[s] or k < 4) + 1
    head, size = (n - 4) << 1, 5
    for s in LENGTH_ORDER[:n]:
        head |= first[s] << size
        size += 3
    codes = _reversed_codes(np.array(first, np.int64)).tolist()
    return head, size + 1, first if sum(map(bool, first)) > 1 else [0] * 19, codes


@lru_cache(1)
def _usual() -> tuple[int, int, list[int], list[int]]:
    """The code for lengths up to `SHORT`, as symbols of text have them: long ones and short runs of zeros come most."""
    return _length_code([3, 1, 1, 2, 4, 8, 12, 16, 20, 24, 0, 0, 0, 0, 0, 0, 0, 8, 6])


class _Writer:
    """Fields of at most 63 bits, lowest bit first: single ones in a list, until a column of them comes."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.single: list[int] = []

    def bits(self, *pairs: tuple[int, int]) -> None:
        self.single += chain.from_iterable(pairs)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.single:
            self.values.append(np.array(self.single[::2], np.int64))
            self.sizes.append(np.array(self.single[1::2], np.int64))
            self.single = []
        self.values.append(values)
        self.sizes.append(sizes)

    def done(self) -> bytes:
        self.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        starts, size = ends - sizes, int(ends[-1])
        values, word, shift = values.view(np.uint64), starts >> 6, (starts & 63).view(np.uint64)
        total = np.zeros((size >> 6) + 2, "<u8")
        first = np.concatenate([[0], (word[1:] != word[:-1]).nonzero()[0] + 1])
        total[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = ((ends - 1) >> 6 > word).nonzero()[0]  # fields that end in the next word
        total[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return total.tobytes()[: (size + 7) >> 3]

    def code(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write a prefix code; (codes, lengths as used)."""
        used = counts.nonzero()[0].tolist()
        if len(used) <= 2 and (not used or used[-1] < 256):
            a = used[0] if used else 0
            wide = int(a > 1)
            self.bits((1, 1), (len(used) == 2, 1), (wide, 1), (a, 8 if wide else 1), *([(used[1], 8)] if len(used) == 2 else []))
            lengths = np.zeros(len(counts), np.int64)
            lengths[used] = int(len(used) == 2)
            return _reversed_codes(lengths), lengths
        lengths = code_lengths(counts, max(SHORT, (len(used) - 1).bit_length() + 1))
        plain = lengths.tolist()
        # (symbol, extra bits, their number): runs of three zeros and more are written as such, all else symbol by symbol.
        shown: list[tuple[int, int, int]] = []
        at = 0
        for k in [*used, len(plain)]:
            zeros = k - at
            while zeros >= 3:
                n = min(zeros, 138)
                shown.append((18, n - 11, 7) if n > 10 else (17, n - 3, 3))
                zeros -= n
            shown += [(0, 0, 0)] * zeros
            if k < len(plain):
                shown.append((plain[k], 0, 0))
            at = k + 1
        if lengths.max() <= SHORT:
            head, size, first, codes = _usual()
        else:
            often = [0] * 19
            for k, _, _ in shown:
                often[k] += 1
            head, size, first, codes = _length_code(often)
        self.bits((head, size))
        self.bits(*[(codes[k] | extra << first[k], first[k] + wide) for k, extra, wide in shown])
        return _reversed_codes(lengths), lengths if len(used) > 1 else np.zeros(len(lengths), np.int64)

    def image(self, pixels: np.ndarray, width: int, top: bool) -> None:
        """pixels: flat, 32 bits each."""
        matches = np.array(_matches(pixels), np.int64).reshape(-1, 3)
        covered = np.zeros(len(pixels) + 1, np.int64)
        covered[matches[:, 0]] += 1
        covered[matches[:, 0] + matches[:, 1]] -= 1  # a match may begin where another ends, so both are sums
        alone = np.cumsum(covered[:-1]) == 0
        keys = ((pixels * _HASH) >> np.uint32(32 - CACHE_BITS)).astype(np.uint16)
        hits = _recur(pixels, keys) & alone
        cache = CACHE_BITS if 5 * np.count_nonzero(hits) > np.count_nonzero(alone) + 400 else 0
        if not cache:
            hits[:] = False
        begins = alone.copy()
        begins[matches[:, 0]] = True
        at = begins.nonzero()[0]
        ref, hit = ~alone[at], hits[at]
        lit = ~(ref | hit)
        blue, green, red, alpha = _bytes(pixels[at]).T.astype(np.int64)
        runs, far = _prefix(matches[:, 1]), _prefix(_distance_codes(matches[:, 2], width))
        symbol = green
        if cache:
            symbol[hit] = 256 + LENGTHS + keys[at[hit]].astype(np.int64)
        symbol[ref] = 256 + runs[0]
        self.bits(*([(1, 1), (cache, 4)] if cache else [(0, 1)]), *([(0, 1)] if top else []))
        codes, lengths = self.code(np.bincount(symbol, minlength=256 + LENGTHS + (1 << cache if cache else 0)))
        fields, sizes = codes[symbol], lengths[symbol]

        def put(rows: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
            fields[rows] |= values << sizes[rows]
            sizes[rows] += widths

        channels = red[lit], blue[lit], alpha[lit]
        counts = [np.bincount(c, minlength=256) for c in channels]
        means = [float(c @ _SAMPLES) / max(1, len(channels[0])) for c in counts]
        if max(means) - min(means) < ALIKE:  # one code for three channels costs little here, and is made once
            before = len(self.single)
            made = [self.code(sum(counts))] * 3
            self.single += self.single[before:] * 2
        else:
            made = [self.code(c) for c in counts]
        for c, (codes, lengths) in zip(channels, made, strict=True):
            put(lit, codes[c], lengths[c])
        codes, lengths = self.code(np.bincount(far[0], minlength=40))
        put(ref, runs[2], runs[1])
        put(ref, codes[far[0]], lengths[far[0]])
        put(ref, far[2], far[1])
        self.many(fields, sizes)


@lru_cache(16)
def _near(width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR):
        out.setdefault(max(1, x + y * width), k + 1)
    return out


def _distance_codes(distances: np.ndarray, width: int) -> np.ndarray:
    near = _near(width)
    return np.array([near.get(d, d + 120) for d in distances.tolist()], np.int64)


def _matches(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance): greedy, from the last place where the same three pixels began."""
    n = len(pixels) - 2
    if n < 2:
        return []
    key = (pixels[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pixels[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + pixels[2:]
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]).nonzero()[0]
    if not len(same):
        return []
    before = np.full(n, -1, np.int64)
    before[order[same + 1]] = order[same]
    out, free = [], 0
    for at in (before >= 0).nonzero()[0].tolist():
        if at < free:
            continue
        start = int(before[at])
        room, size = min(4096, len(pixels) - at), 0
        while size < room:
            part = min(64, room - size)
            differ = (pixels[start + size : start + size + part] != pixels[at + size : at + size + part]).nonzero()[0]
            size += int(differ[0]) if len(differ) else part
            if len(differ):
                break
        if size >= 3:
            out.append((at, size, at - start))
            free = at + size
    return out


def _recur(pixels: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the colour cache holds a pixel when it comes."""
    order = np.argsort(keys, kind="stable")
    hits = np.zeros(len(pixels), bool)
    hits[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return hits


def _bits_of(counts: np.ndarray) -> float:
    """Bits to write symbols of these counts and their code, roughly."""
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum()) + 4 * len(counts)


def _entropy(symbols: np.ndarray) -> float:
    return _bits_of(np.bincount(symbols, minlength=256))


def _cost(channels: np.ndarray) -> float:
    """The same for each of four channels together."""
    counts = np.bincount((channels.reshape(-1, 4) + np.arange(0, 1024, 256)).ravel(), minlength=1024)
    counts = counts[counts > 0]
    n = channels.size // 4
    return 4 * n * float(np.log2(n)) - float((counts * np.log2(counts)).sum()) + 4 * len(counts)


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """Mean difference of samples."""
    return float(np.abs((a - b).view(np.int8).astype(np.int16)).mean()) if a.size else 0.0


def encode(samples: np.ndarray) -> bytes:
    """A (height, width, 4) array of red, green, blue and alpha samples as one lossless file."""
    height, width, _ = samples.shape
    out, pixels = _Writer(), _pixels(samples[..., [2, 1, 0, 3]])
    out.bits((width - 1, 14), (height - 1, 14), (int(samples[..., 3].min() < 255), 1), (0, 3))
    now = _bytes(pixels)
    best = None
    colours = np.unique(pixels) if len(set(pixels.ravel()[:1024].tolist())) <= 256 else None
    if colours is not None and len(colours) <= 256:
        index = np.searchsorted(colours, pixels)
        bits = _bundle(len(colours))
        best = _cost(now)
        if 20 * len(colours) + _entropy(index.ravel()) < best:
            out.bits((1, 1), (PALETTE, 2), (len(colours) - 1, 8))
            steps = _bytes(colours).copy()
            steps[1:] -= _bytes(colours)[:-1]
            out.image(_pixels(steps), len(colours), False)
            each = 8 >> bits
            packed = np.zeros((height, -(-width // (1 << bits)) << bits), np.int64)
            packed[:, :width] = index
            packed = (packed.reshape(height, -1, 1 << bits) << (np.arange(1 << bits) * each)).sum(axis=2)
            pixels = (packed << 8 | BLACK).astype(np.uint32)
            out.bits((0, 1))
            out.image(pixels.ravel(), pixels.shape[1], True)
            return _boxed(out.done())
    chosen, plain = None, now
    smooth, alike = _apart(plain[:, 1:], plain[:, :-1]) < SMOOTH, _apart(plain[..., :3:2], plain[..., 1:2]) < SMOOTH
    if (smooth or alike) and best is None:
        best = _cost(now)
    if smooth:
        for mode in (1, 2) if height > 1 else (1,):
            rest = plain.copy()
            rest[0, 0, 3] = (int(rest[0, 0, 3]) + 1) & 255
            rest[0, 1:] -= plain[0, :-1]
            rest[1:, 0] -= plain[:-1, 0]
            rest[1:, 1:] -= plain[1:, :-1] if mode == 1 else plain[:-1, 1:]
            if (cost := _cost(rest) + 60) < best:
                best, now, chosen = cost, rest, mode
    side = -(-width // 512), -(-height // 512)
    if chosen:
        out.bits((1, 1), (PREDICTOR, 2), (7, 3))
        out.image(np.full(side[0] * side[1], BLACK | chosen << 8, np.uint32), side[0], False)
    if chosen or alike:
        factor = 32  # one to one, in 32nds: red and blue as they follow green
        crossed, green = now.copy(), now.copy()
        crossed[..., :3:2] -= _cross(factor, np.ascontiguousarray(now[..., 1]))[..., None]
        green[..., :3:2] -= now[..., 1:2]
        costs = {None: best, CROSS: _cost(crossed) + 60, GREEN: _cost(green)}
        kind = min(costs, key=lambda k: costs[k])
        if kind == CROSS:
            now = crossed
            out.bits((1, 1), (CROSS, 2), (7, 3))
            out.image(np.full(side[0] * side[1], BLACK | factor << 8 | factor, np.uint32), side[0], False)
        elif kind == GREEN:
            now = green
            out.bits((1, 1), (GREEN, 2))
    out.bits((0, 1))
    out.image(_pixels(now).ravel(), width, True)
    return _boxed(out.done())


def _boxed(bits: bytes) -> bytes:
    data = b"\x2f" + bits
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# Byte columns


def store(payload: bytes) -> bytes:
    """A payload of whole rows as one or more files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 4)
    return b"".join(encode(rows[at : at + MOST_ROWS]) for at in range(0, len(rows), MOST_ROWS))


def files(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield media[at : at + size]
        at += size


def load(media: bytes) -> bytes:
    return b"".join(decode(x).tobytes() for x in files(media))


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in parts(batch, 1):
            made = [(n, store(payload)) for n, payload in (padded(t.as_py()) for t in some.column(1))]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media, the padded text as lossless WebP."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in parts(batch, at := batch.schema.names.index("media")):
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array([None if m.as_py() is None else load(m.as_py()) for m in some.column(at)], pa.binary())], [*some.schema.names, "samples"])


def load_media(media: DataFrame) -> DataFrame:
    """media with column samples: red, green, blue and alpha of each pixel, row by row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(_loaded, f"{fields}, samples binary")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media, samples in zip(batch.column("media").to_pylist(), batch.column("samples").to_pylist(), strict=True):
            values = np.frombuffer(samples, np.uint8)
            shares = np.bincount(values >> 4, minlength=16) * 255 // len(values)
            feature = f"{len(values) // ROW}:{values.reshape(-1, 4).mean(axis=0).astype(int).tolist()}:{bytes(shares.astype(np.uint8)).hex()}".replace(" ", "")
            rows.append((len(samples), sha256(samples).hexdigest(), crc32(samples[-32:]), len(media), sha256(media).hexdigest(), feature))
        kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: what the contract of the query names; `feature` is rows, mean samples and the shares of sixteen tones.

    The three steps of a row follow each other in one worker, so that neither files nor samples go through the JVM.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text))
    return docs.mapInArrow(lambda batches: _described(_loaded(_stored(batches))), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
