"""Toxicity scores of text that may be obfuscated.

1. A character trigram model is counted over all texts. Its alphabet is fixed (a boundary, a-z, ß-ÿ, any other letter),
   so the table that reaches the driver has at most len(alphabet) ** 3 entries, whatever the corpus holds.
2. A token with look-alike signs or stretched letters, and a stretch of spaced letters, becomes a lattice: a sign may stand for several
   letters, a run of a letter for one or two of it, a star for a vowel or nothing, a gap between letters for nothing or the end of a
   word. Viterbi takes the likeliest letters and words.
3. Words and word beginnings of the restored text are counted by label, in hash buckets of a fixed number. A bucket's
   weight is the lower confidence bound of its log-odds, a text's evidence the sum of its `TOP` largest word weights, and a
   logistic curve fitted on labelled texts that the weights have not seen turns that into a probability.

The classifier is fitted on at most `LABELLED` labelled rows, in the order of a hash of their doc_id; rows held out by the caller's rule are never
among them. Counts for the character model and scores cover every text, whole.

Defined cases: null and empty texts have no evidence and get the lowest score; several labels of one doc_id count as toxic if
any is, rows with a null doc_id or label teach nothing; equal texts get equal scores; without usable labels every score is the same; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import nlargest
from math import exp, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED, BUCKETS, TOP, THRESHOLD = 50_000, 2**20, 3, 0.3
MEMO = 200_000

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIGNS = len(_LETTERS) + 2  # boundary first, any other letter last
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
#: What a sign may stand for. Fixed values.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou",
}
_SWAP = log(0.05)  # cost of reading a sign as a letter and of shortening a run; dropping a sign or undoubling a letter costs twice as much
_SPACED = re.compile(r"(?<![\w@$])(?:[^\W_@$]?[^\W_](?:[ .\-_][^\W_]){3,}|[^\W\d_][ .\-_][^\W_][ .\-_][^\W\d_])(?![\w@$])")
#: Chance that a gap within spaced letters ends a word: one like most of the stretch, a blank or another sign; a gap unlike them, or after two letters in a row.
BREAK = {"blank": 0.2, "sign": 0.02, "unlike": 0.95}
_ODD = re.compile(r"[^\W\d_][0-9@$!|+€*]+[^\W\d_]|^[0-9@$|€]{1,2}[^\W\d_]|^[!+][^\W\d_]{3}|[^\W\d_][0-9@$€]{1,2}$|[^\W\d_]{3}\+$|([^\W\d_])\1\1|[^\W\d_][.\-_][^\W\d_][.\-_][^\W\d_]")
#: Stands at the end of whatever `_SPACED` matches.
_GAPS = re.compile(r"[ .\-_][^\W_][ .\-_][^\W_](?!\w)")
_TOKEN_END = re.compile(r"\s|\Z")
STEP = 1_000_000  # characters of a text that are looked at for hints at a time


@cache
def _kinds() -> np.ndarray:
    """What may be next to what in a token that `_ODD` matches, by character: 1 letters, 2 signs after one, 4 signs before one, 8 signs between. Rare characters count as letters."""
    out = np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(0x10000))], np.uint8)
    for sign in "0123456789@$!|+€*":
        out[ord(sign)] |= 2
    for sign in "0123456789@$|€!+":
        out[ord(sign)] |= 4
    for sign in ".-_":
        out[ord(sign)] |= 8
    out[-1] = 1
    return out


def _hints(text: str) -> np.ndarray:
    """Places in tokens that `_ODD` may match: of a letter by a sign, of a letter three times, of a letter between two signs. Others need no look."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < 2:
        return np.zeros(0, np.int64)
    kind = _kinds()[np.minimum(points, 0xFFFF)]
    letter, same, found = kind & 1, points[1:] == points[:-1], np.zeros(len(points), bool)
    found[:-1] = (letter[:-1] & (kind[1:] >> 1)) | ((kind[:-1] >> 2) & letter[1:])
    found[:-2] |= same[1:] & same[:-1] & (letter[:-2] == 1)
    found[:-2] |= (kind[:-2] >> 3) & letter[1:-1] & (kind[2:] >> 3) == 1
    return np.flatnonzero(found)


_EDGE = ".,;:?!()[]{}\"'#%&<>=~`^\\/-_"
_WORDS = re.compile(r"[^\W\d_]+")


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.zeros(len(points), np.int64)
    small = points < 0x100
    codes[small] = _TABLE[points[small]]
    codes[~small] = SIGNS - 1
    return codes


_TABLE = np.array([_CODE.get(chr(p), 0) for p in range(0x100)], np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIGNS**3, np.int64)
    for batch in batches:
        for at in range(0, len(batch), 200):
            codes = _codes(" ".join(["", *(t.as_py() or "" for t in batch.column(0)[at : at + 200]), ""]))
            a, b, c = np.concatenate([[0], codes[:-2]]), codes[:-1], codes[1:]
            ids = (np.where(b == 0, 0, a) * SIGNS + b) * SIGNS + c
            counts += np.bincount(ids[(b > 0) | (c > 0)], minlength=SIGNS**3)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) at [a, b, c]; trigrams eased by bigrams, those by letters."""
    found = docs.select(text).mapInArrow(_trigrams, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most SIGNS ** 3 rows
    three = np.zeros(SIGNS**3)
    three[found["id"].to_numpy()] = found["n"].to_numpy()
    three = three.reshape(SIGNS, SIGNS, SIGNS)
    one = (three.sum((0, 1)) + 1) / (three.sum() + SIGNS)
    two = three.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 20 * two) / (three.sum(2, keepdims=True) + 20)).astype(np.float32)


def _lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Per run of a sign, or of gaps: (letters, cost) choices. A blank ends a word; only `spaced` letters have such choices."""
    out = []
    gaps = Counter(re.findall(r"[ .\-_]+", token)).most_common(1) if spaced else []
    for run in re.finditer(r"([ .\-_])[ .\-_]*|(.)\2*", token, re.DOTALL):
        sign, n, at = run[1] or run[2], len(run[0]), run.start()
        if run[1]:
            if spaced:
                like = run[0] == gaps[0][0] and not (at > 1 and token[at - 2] not in " .-_")
                ends = BREAK["unlike" if not like else "blank" if sign == " " else "sign"]
                out.append([("", log(1 - ends)), (" ", log(ends))])
        elif sign in LOOKALIKES:
            choices = [(x * k, _SWAP * n) for x in LOOKALIKES[sign] for k in ((1, 2) if n > 1 else (1,))]
            out.append(choices + ([("", 2 * _SWAP)] if sign in "*!|+" else []))
        elif sign.isalpha():
            out.append([(sign, 0.0 if n == 1 else 2 * _SWAP if n == 2 else _SWAP)] + ([(sign * 2, 0.0 if n == 2 else _SWAP)] if n > 1 else []))
        # any other sign is dropped
    return out


def decode_token(token: str, model: list[float], spaced: bool = False) -> str:
    """The likeliest letters of a token's lattice, words apart by blanks. model: the character model, flat."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # last two letters -> (score, (letters, those before))
    for choices in _lattice(token, spaced):
        now: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for more, cost in choices:
                s, x, y = score + cost, a, b
                for c in more:
                    if c == " ":
                        s += model[(x * SIGNS + y) * SIGNS]
                        x = y = 0
                    else:
                        z = _CODE.get(c, SIGNS - 1)
                        s += model[(x * SIGNS + y) * SIGNS + z]
                        x, y = y, z
                if (x, y) not in now or s > now[x, y][0]:
                    now[x, y] = s, (more, path) if more else path
        best = now
    _, path = max(((s + model[(a * SIGNS + b) * SIGNS], path) for (a, b), (s, path) in best.items()), key=lambda x: x[0])
    letters = []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


class Restorer:
    def __init__(self, model: np.ndarray) -> None:
        self.model, self.known = model.ravel().tolist(), {}

    def token(self, token: str) -> str:
        if (known := self.known.get(token)) is not None:
            return known
        if len(self.known) >= MEMO:
            self.known.clear()
        bare = token.strip(_EDGE)
        before = token[: len(token) - len(token.lstrip(_EDGE))]
        if before.endswith("!") and not before.endswith("!!"):  # a single one may be the first letter
            bare = f"!{bare}"
        bare = re.sub(r"^[$*@|+]{3,}|[$*@|+]{3,}$", "", bare)
        self.known[token] = out = decode_token(bare, self.model) if _ODD.search(bare) else token
        return out

    def text(self, text: str) -> str:
        """Lower-cased, with suspicious tokens decoded."""
        low = text.lower()
        if _GAPS.search(low):
            low = _SPACED.sub(lambda m: decode_token(m[0], self.model, True), low)
        if len(low) <= STEP:
            return self._piece(low)
        cuts = [0]
        while cuts[-1] < len(low):
            cuts.append(_TOKEN_END.search(low, min(cuts[-1] + STEP, len(low))).end())
        return "".join(self._piece(low[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def _piece(self, low: str) -> str:
        """Only tokens with a hint are looked at."""
        out, at = [], 0
        for hint in _hints(low).tolist():
            if hint < at:
                continue
            start = hint
            while start > at and not low[start - 1].isspace():
                start -= 1
            end = _TOKEN_END.search(low, hint).start()
            out += [low[at:start], self.token(low[start:end])]
            at = end
        return "".join([*out, low[at:]]) if out else low


def _buckets(word: str) -> tuple[int, ...]:
    """A word's features: itself, and its beginnings of four to six letters."""
    return tuple({crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in (word + "$", *(word[:k] for k in (4, 5, 6) if len(word) >= k))})


def _learned(model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, known = Restorer(model.value), {}
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, toxic in zip(*batch.columns, strict=True):
                features: set[int] = set()
                for word in set(_WORDS.findall(restore.text(text.as_py() or ""))):
                    if word not in known:
                        if len(known) >= MEMO:
                            known.clear()
                        known[word] = _buckets(word)
                    features.update(known[word])
                counts[toxic.as_py(), list(features)] += 1
        some = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])], ["id", "clean", "toxic"])

    return of


def bucket_weights(learn: DataFrame, model) -> np.ndarray:
    """Weight per bucket, 0 where nothing speaks for toxic. learn: text, toxic (0 or 1)."""
    n = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    found = learn.select("text", "toxic").mapInArrow(_learned(model), "id long, clean long, toxic long").groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # at most BUCKETS rows
    clean, toxic = (found[c].to_numpy() for c in ("clean", "toxic"))
    odds = np.log((toxic + 0.5) / (n.get(1, 0) + 1)) - np.log((clean + 0.5) / (n.get(0, 0) + 1))
    low = odds - 1.64 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    out = np.zeros(BUCKETS, np.float32)
    out[found["id"].to_numpy()] = np.where(toxic >= 3, np.maximum(0, low), 0)
    return out


def _weighed(model, weights):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, table, known = Restorer(model.value), weights.value, {}
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1):
                found = []
                for word in set(_WORDS.findall(restore.text(text.as_py() or ""))):
                    if (w := known.get(word)) is None:
                        if len(known) >= MEMO:
                            known.clear()
                        w = known[word] = float(max(table[b] for b in _buckets(word)))
                    if w:
                        found.append(w)
                out.append(sum(nlargest(TOP, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], "evidence"])

    return of


def fit_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b x))) by Newton steps with a small prior, over (x, clean, toxic) bins."""
    a, b = -2.0, 1.0
    if not any(t for _, _, t in bins) or not any(c for _, c, _ in bins):
        return a, b
    for _ in range(50):
        g0, g1, h00, h01, h11 = 0.0, -(b - 1) * 0.1, 1e-6, 0.0, 0.1
        for x, c, t in bins:
            p = 1 / (1 + exp(-max(-30, min(30, a + b * x))))
            g0, g1 = g0 + t - (c + t) * p, g1 + (t - (c + t) * p) * x
            w = (c + t) * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, max(0.05, b + step * db)
        if abs(da) + abs(db) < 1e-7:
            break
    return a, b


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Held out: crc32(doc_id as text) mod 4 is 2. Remainder 3 fits the curve, 0 and 1 the weights."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).alias("toxic")).where("doc_id is not null and toxic is not null").where(fold != 2)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("fold", fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).checkpoint()  # bounded by `labelled`, so it may be sent to all
    model = spark.sparkContext.broadcast(character_model(docs))
    weights = spark.sparkContext.broadcast(bucket_weights(docs.join(F.broadcast(known.where("fold < 2")), "doc_id").select("text", "toxic"), model))
    held = docs.join(F.broadcast(known.where("fold = 3")), "doc_id").select("toxic", "text").mapInArrow(_weighed(model, weights), "toxic int, evidence double")
    bins = held.groupBy(F.round("evidence", 1).alias("x")).agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).orderBy("x").collect()  # evidence is below 3 * log(2 * LABELLED)
    a, b = fit_curve([(r["x"], r["c"], r["t"]) for r in bins])
    weighed = docs.mapInArrow(_weighed(model, weights), "doc_id long, evidence double")
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence"))))
    return weighed.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
