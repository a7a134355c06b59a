"""Importance resampling towards a target distribution over hashed word n-grams.

A feature is a run of one to three consecutive words joined by one space; its bucket is its CRC-32 modulo `buckets`. No
n-gram is ever put together: each word's CRC is computed once, all words of a part of the table at a time, and the CRC of an n-gram
follows from those of its words. The CRC of A followed by B is that of A, moved on by the length of B, xor that of B;
moving on by a length is a 32 x 32 matrix over GF(2), kept as four tables of 256 entries for each length below `NEAR`
and for each power of two above it.

1. Features of the raw table and of the target are counted per bucket, summed in the tasks first; both are `buckets` numbers.
2. A bucket's gain is the scaled logarithm of the ratio of its two smoothed shares. A text's weight is the sum of its features'
   gains, found on a second pass over the texts, so no list of features is stored.
3. Gumbel noise from a hash of the id turns the weights into a draw without replacement: the rows with the highest scores are drawn. Places
   come from ranges of the scores (`running`), so neither a task nor the driver holds all drawn rows.

Defined cases: null and empty texts, and texts without words, have no features, weight 0 and are never drawn, as they have fewer than `least_words` words; a
text of any length is read in pieces, and its features run across them; repeats of a row are separate documents with equal weights and scores, which
take consecutive ranks; a null id counts as the empty string in the noise and comes last among ties; an empty target counts
as 0 in every bucket, an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import parts
from tessera.scans import running
from tessera.shared import materialise

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
NEAR = 64  # lengths in bytes below it have tables of their own
PIECE = 1_000_000  # bytes of a text that are read at a time; a longer word comes alone
LONGEST = 48  # bytes of a word that are taken step by step with those of all others; what is longer goes to zlib
_POLYNOMIAL = 0xEDB88320  # CRC-32, reflected
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@cache
def _byte_steps() -> np.ndarray:
    """What one byte does to a CRC register."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(_POLYNOMIAL), x >> 1).astype(np.uint32)
    return x


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Four tables of 256 entries, one for each byte of x, stand for a matrix over GF(2)."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


@cache
def _near_shifts() -> np.ndarray:
    """(4, NEAR * 256): tables of the shifts by 0 to NEAR - 1 zero bytes, that of a length at 256 times the length."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [one]
    for _ in range(1, NEAR):
        out.append(_byte_steps()[out[-1] & 255] ^ (out[-1] >> 8))
    return np.stack(out, axis=1).reshape(4, -1)


@cache
def _far_shift(power: int) -> np.ndarray:
    """Tables of the shift by NEAR * 2 ** power zero bytes: the one before it applied twice."""
    if power:
        half = _far_shift(power - 1)
        return _applied(half, half)
    x = _near_shifts().reshape(4, NEAR, 256)[:, NEAR - 1]
    return _byte_steps()[x & 255] ^ (x >> 8)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved on by so many bytes."""
    near, at = _near_shifts(), (lengths & (NEAR - 1)).astype(np.uint32) << 8
    out = near[0][at | (crcs & 255)] ^ near[1][at | ((crcs >> 8) & 255)] ^ near[2][at | ((crcs >> 16) & 255)] ^ near[3][at | (crcs >> 24)]
    far, power = lengths // NEAR, 0
    while far.any():
        some = np.flatnonzero(far & 1)
        out[some] = _applied(_far_shift(power), out[some])
        far, power = far >> 1, power + 1
    return out


def combined(crcs: np.ndarray, after: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of strings followed by other ones, whose CRCs are `after` and whose lengths are `lengths`."""
    return shifted(crcs, lengths) ^ after


def word_crcs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in some bytes, A-Z lowered: CRCs, starts, and lengths in bytes."""
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths, low = ends - starts, _LOWER[data]
    order = np.argsort((LONGEST + 1 - np.minimum(lengths, LONGEST + 1)).astype(np.uint8), kind="stable")  # longest first
    sorted_lengths = lengths[order]
    long = int(np.searchsorted(-sorted_lengths, -LONGEST, "left"))
    places, registers, steps = starts[order[long:]], np.full(len(order) - long, 0xFFFFFFFF, np.uint32), _byte_steps()
    left = np.searchsorted(-sorted_lengths[long:], -np.arange(LONGEST + 1), "left")  # words of more than so many bytes
    for k in range(LONGEST):
        if not (n := int(left[k])):
            break
        registers[:n] = steps[(registers[:n] ^ low[places[:n] + k]) & 255] ^ (registers[:n] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order[long:]] = ~registers
    for i in order[:long]:
        out[i] = zlib.crc32(low[starts[i] : ends[i]].tobytes())
    return out, starts, lengths


_SPACE = np.uint32(zlib.crc32(b" "))


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, rows: np.ndarray, width: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to width: the CRCs of all runs of n words of one row, and the places of their last words."""
    spaced = combined(np.full(len(crcs), _SPACE, np.uint32), crcs, lengths)  # a space and the word
    goes_on_after = np.append(rows[1:] == rows[:-1], False)[: len(rows)]
    runs, ends = crcs, np.arange(len(crcs))
    yield runs, ends
    for _ in range(width - 1):
        goes_on = goes_on_after[ends]
        ends = ends[goes_on] + 1
        runs = combined(runs[goes_on], spaced[ends], lengths[ends] + 1)
        yield runs, ends


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """A text's bytes in pieces that end between words."""
    at = 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data) and _IS_WORD[data[stop]]:
            stop += 1
        yield np.frombuffer(data, np.uint8, stop - at, at)
        at = stop


def features(texts: Iterable[str | None], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Buckets of the features of some texts, with the text that each belongs to; the number of the first text and of those after the last, whose
    features are then whole but for a long text, which comes in several pieces. A text's number of words is that of its features of one word."""
    held: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > PIECE:
            yield _of_short(held, buckets), first, i
            held, size, first = [], 0, i
        if len(data) > PIECE:
            yield from ((found, i, i + 1) for found in _of_long(data, buckets))
            first = i + 1
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield _of_short(held, buckets), first, first + len(held)


def _of_short(texts: list[bytes], buckets: int):
    crcs, starts, lengths = word_crcs(np.frombuffer(b" ".join([*texts, b""]), np.uint8))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    rows = np.searchsorted(ends, starts, "right")
    return [(runs % np.uint32(buckets), rows[at]) for runs, at in ngram_crcs(crcs, lengths, rows)]


def _of_long(data: bytes, buckets: int):
    crcs, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for piece in _pieces(data):
        before = len(crcs)  # of words whose own features are out already
        more, _, size = word_crcs(piece)
        crcs, lengths = np.concatenate([crcs, more]), np.concatenate([lengths, size])
        rows = np.zeros(len(crcs), np.int64)
        yield [(runs[at >= before] % np.uint32(buckets), rows[at[at >= before]]) for runs, at in ngram_crcs(crcs, lengths, rows)]
        crcs, lengths = crcs[-2:], lengths[-2:]


def _counting(buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in parts(batch, 0):
                for found, _, _ in features((t.as_py() for t in some.column(0)), buckets):
                    for runs, _ in found:
                        counts += np.bincount(runs, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    return of


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. The driver gets one row per bucket at most."""
    found = texts.select(F.col(text).alias("text")).mapInArrow(_counting(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))), S and T being the sums."""
    n = len(raw)
    all_raw, all_target = float(raw.sum() + n), float(target.sum() + n)
    return np.floor(1000 * np.log((target + 1.0) * all_raw / ((raw + 1.0) * all_target))).astype(np.int64)


def _weighing(gain, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gain.value
        for batch in batches:
            for some in parts(batch, 1):
                n_words, n_features, weight = (np.zeros(len(some), np.int64) for _ in range(3))
                for found, first, stop in features((t.as_py() for t in some.column(1)), buckets):
                    for n, (runs, rows) in enumerate(found):
                        count = np.bincount(rows, minlength=stop - first)
                        n_features[first:stop] += count
                        n_words[first:stop] += count if n == 0 else 0
                        weight[first:stop] += np.bincount(rows, table[runs], stop - first).astype(np.int64)  # whole numbers, exact below 2 ** 53
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return of


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features and weight, the sum of its features' gains."""
    known = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_weighing(known, len(gain)), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")


def draw(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight) with their score, and the rank of those drawn."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = materialise(rows.withColumn("score", score.cast("long")).withColumn("able", (F.col("n_words") >= least_words).cast("long")), "scored")
    most = percent * scored.agg(F.coalesce(F.sum("able"), F.lit(0))).first()[0] // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = running(scored, [], order, {"place": F.lit(1).cast("long")})
    return placed.withColumn("rank", F.when((F.col("able") == 1) & (F.col("place") <= most), F.col("place"))).drop("able", "place")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_features, weight, score, and rank if it is drawn towards the texts of target."""
    gain = gains(bucket_counts(docs, buckets=buckets), bucket_counts(target, buckets=buckets))
    return draw(weighed(docs, gain), least_words, percent, seed)
