"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text gets its distinct word shingles, a MinHash signature and one key per band (one pass over the texts).
2. Texts with equal shingle sets become one node, numbered as the table of nodes is written.
3. Nodes that share a band key are candidates. A bucket is not expanded into its pairs: in each round a few pivots of
   it meet the members that are not yet in their component, and leave the bucket. Members already connected need no
   comparison. The first round takes an eighth of the buckets, the second all that still hold two components.
   Texts that are left then (crowds of texts a little under the threshold) change to exact buckets: the prefixes of their
   shingle sets, rarest shingles first. Two sets at the threshold share a shingle of their prefixes, and the first one that they
   share leaves enough on both sides for the overlap; other pairs are not formed. Each later round has 16 times the pivots, until no
   bucket holds two components, so no candidate pair that could change a component is left out.
4. A candidate pair is pruned by its signatures, compared `BATCH` values at a time: it goes as soon as the posterior
   probability of a similarity at or above the threshold falls under `MISS`.
5. Pairs that are left are verified exactly on their full shingle sets, a shingle being its 64-bit hash.

Defined cases: null and empty texts have no shingles and link with nothing; a text of fewer words than the shingle
length is one shingle; equal rows get equal results; rows without a doc_id link with nothing, get a null component and are kept;
different texts under one doc_id are different documents, each with its own links, though components are named by the smallest doc_id;
an empty table gives an empty result; other columns are not read by `near_duplicates` and pass through `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import fresh, parts
from tessera.llm.components import components
from tessera.llm.shingles import mix, shingle_sets
from tessera.shared import discard, few, materialise, together

BANDS, ROWS = 40, 6  # a pair at similarity 0.8 shares no band with probability 5e-6
HASHES = BANDS * ROWS
BATCH, MISS = 40, 1e-7
FIRST_SHARE = 8  # the first round takes one bucket in so many: it connects most of each group, and the other buckets then need no comparison
_SEEDS = np.random.Generator(np.random.PCG64(20011)).integers(1, 2**32, (2, HASHES), dtype=np.uint32)
SKETCH = 2**20  # counters by which shingles are put in order of rarity; any order gives the same links


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima; shingles must not be empty."""
    out, x = np.full(HASHES, 2**32 - 1, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for part in range(0, len(x), 1024):
        y = x[None, part : part + 1024] * (_SEEDS[0] | np.uint32(1))[:, None] + _SEEDS[1][:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x846CA68B)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, HASHES) minima to (n, BANDS) keys."""
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)).copy()
    for k in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + signatures.reshape(-1, BANDS, ROWS)[:, :, k])
    return acc.view(np.int64)


def _signed(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 1):  # so that one part's signatures stay small
                made, signed = [], []
                for s in shingle_sets((t.as_py() for t in some.column(1)), words):
                    made.append((len(s), blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None))
                    if len(s):
                        signed.append(signature(s))
                keys = iter(band_keys(np.array(signed, np.uint32).reshape(-1, HASHES)))
                bands = [next(keys) if n else None for n, _ in made]
                columns = pa.array([n for n, _ in made], pa.int64()), pa.array([d for _, d in made], pa.binary()), pa.array(bands, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *columns], ["doc_id", "key", "n_shingles", "digest", "bands"])

    return of


def least_matches(n: int, percent: int, miss: float = MISS) -> int:
    """Fewest equal values among n with which P(similarity >= percent / 100) is at least `miss`, under a uniform prior.

    Values are one byte, so unequal ones agree by chance once in 256. The Beta posterior's tail is a binomial sum.
    """
    s = percent / 100 + (1 - percent / 100) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


def _pruned(percent: int):
    need = [(n, least_matches(n, percent)) for n in range(BATCH, HASHES + 1, BATCH)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sig_a, sig_b = batch.columns
            if not len(a):
                continue
            x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, HASHES) for s in (sig_a, sig_b))
            alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n, least in need:
                equal[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                alive = alive[equal[alive] >= least]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(alive)), b.take(pa.array(alive))], ["a", "b"])

    return of


def _packed(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 1):
                small, full = [], []
                for s in shingle_sets((t.as_py() for t in some.column(1)), words):  # nodes have a shingle at least
                    small.append(signature(s).astype(np.uint8).tobytes())
                    full.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(small, pa.binary()), pa.array(full, pa.binary())], ["node", "sig", "shingles"])

    return of


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_py(), np.uint64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for some in parts(batch, 0):
            sets = [_unpacked(s) & np.uint64(SKETCH - 1) for s in some.column(0)]
            np.add.at(counts, np.concatenate(sets).astype(np.int64), 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["id", "n"])


def _prefixed(counts, percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 2):
                nodes, labels, packed = some.columns
                keys, sizes = [], []
                for s in packed:
                    x = _unpacked(s)
                    rarest = np.lexsort((x, counts.value[(x & np.uint64(SKETCH - 1)).astype(np.int64)]))
                    keys.append(x[rarest[: len(x) + 1 - -(-percent * len(x) // 100)]])
                    sizes.append(len(x))
                each = [len(k) for k in keys]
                row = np.repeat(np.arange(len(each)), each)
                place = np.concatenate([np.arange(n) for n in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), nodes.take(pa.array(row)), labels.take(pa.array(row)), pa.array(np.array(sizes)[row]), pa.array(place)], ["key", "node", "label", "n", "place"])

    return of


def _prefix_buckets(sets: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """Buckets by prefix shingle of the nodes of `left` (node, label), written."""
    sets = materialise(left.join(sets, "node").select("node", "label", "shingles"), "left")
    found = sets.select("shingles").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    counts = np.zeros(SKETCH, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    known = sets.sparkSession.sparkContext.broadcast(counts)
    out = materialise(sets.mapInArrow(_prefixed(known, percent), "key long, node long, label long, n long, place long"), "active")
    known.unpersist()
    discard(sets)
    return out


def _confirmed(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, set_a, set_b = batch.columns
            keep = []
            for s, t in zip(set_a, set_b, strict=True):
                x, y = _unpacked(s), _unpacked(t)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return of


def _unsettled(active: DataFrame, rows: int) -> DataFrame:
    """Keys of buckets that still hold two components."""
    return few(active.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")), rows).where("low <> high").select("key")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, text and key: rows with equal doc_id and key are repeats of one row."""
    key = F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit(""))))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), key.alias("key"))


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of docs (doc_id, text, key): doc_id, key, n_shingles, component (a number; null without a doc_id or shingles) and component_id."""
    signed = materialise(docs.mapInArrow(_signed(words), "doc_id long, key binary, n_shingles long, digest binary, bands array<long>"), "signed")
    nodes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
    nodes = nodes.agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    active = materialise(buckets.join(full, "key").select("key", "node", F.col("node").alias("label"), "n", F.lit(0).cast("long").alias("place")).distinct(), "active")
    involved = nodes.join(active.select("node").distinct(), "node", "left_semi").select("first.doc_id", "first.key", "node")
    sets = docs.join(involved, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("node", "text")
    sets = materialise(sets.mapInArrow(_packed(words), "node long, sig binary, shingles binary"), "sets")
    n_active, n_sets = active.count(), 20 * sets.count()  # a set is some twenty times the size of a bucket's row

    links, tested, labels, n_links, pivots, share, exact = [], [], None, 0, 1, FIRST_SHARE, False
    overlap = f"{100 + percent} * least(n - place, pivot_n - pivot_place) >= {percent} * (n + pivot_n)"  # at place 0: sizes alike enough
    while n_active:
        left = few(active.join(_unsettled(active, n_active), "key", "left_semi"), n_active)
        now = left.where(F.pmod("key", F.lit(share)) == 0)
        front = now.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(pivots)).alias("part")).agg(F.min_by(F.struct("node", "label", "n", "place"), "node").alias("p"))
        front = few(front, n_active).select("key", F.col("p.node").alias("pivot"), *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("label", "n", "place")])
        met = few(now.join(front, "key"), n_active).where("node <> pivot and label <> pivot_label").where(overlap)
        pairs = few(met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), n_active)
        if tested:
            pairs = few(pairs.join(together(tested), ["a", "b"], "left_anti"), n_active)
        pairs = materialise(pairs, "pairs")
        tested.append(pairs)
        with_signs, with_sets = (lambda end, c=c: sets.select(F.col("node").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in c]) for c in (("sig",), ("shingles",)))
        near = few(few(pairs.join(with_signs("a"), "a"), n_sets).join(with_signs("b"), "b"), n_sets)
        near = few(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_pruned(percent), "a long, b long").distinct(), n_active)
        sure = few(few(near.join(with_sets("b"), "b"), n_sets).join(with_sets("a"), "a"), n_sets)
        sure = materialise(sure.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirmed(percent), "a long, b long"), "links")
        if new := sure.count():
            links.append(sure)
            n_links += new
            if labels is not None:
                discard(labels)
            labels = materialise(components(together(links), n_links), "labels")
        rest = few(left.join(front.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti"), n_active)
        if labels is not None:
            rest = few(rest.drop("label").join(labels, "node", "left"), n_active).select("key", "node", F.coalesce("label", "node").alias("label"), "n", "place")
        rest = materialise(few(rest.join(_unsettled(rest, n_active), "key", "left_semi"), n_active), "active")
        discard(active)
        active, n_active = rest, rest.count()
        if share > 1:
            share = 1
        elif not exact and n_active:
            exact = True
            before, active = active, _prefix_buckets(sets, active.select("node", "label").distinct(), percent)
            discard(before)
            n_active = active.count()
        else:
            pivots *= 16
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    labelled = nodes.select("digest", "node", F.col("first.doc_id").alias("own")).join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component"), "own")
    smallest = labelled.groupBy("component").agg(F.min("own").alias("smallest"))
    of_set = labelled.join(smallest, "component").select("digest", "component", "smallest")
    out = signed.select("doc_id", "key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(of_set, "digest", "left")
    return out.select("doc_id", "key", "n_shingles", "component", F.coalesce("smallest", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id)."""
    found = grouped(_keyed(docs, id_col, text), words, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the smallest doc_id (of different texts under it, one); repeats of a row
    without shingles leave one, rows without an id all stay. The texts are shuffled once."""
    keyed = _keyed(docs, id_col, text)
    found = grouped(keyed, words, percent).where("doc_id is not null")
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.doc_id", "first.key")
    chosen = first.unionByName(found.where("component is null").select("doc_id", "key").distinct())
    at, key = fresh(docs.columns, "_near_id"), fresh(docs.columns, "_near_key")
    marked = docs.select("*", F.col(id_col).cast("long").alias(at), F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("")))).alias(key))
    one = marked.join(chosen.select(F.col("doc_id").alias(at), F.col("key").alias(key)), [at, key], "left_semi").dropDuplicates([at, key])
    return one.select(docs.columns).unionByName(docs.where(F.col(id_col).cast("long").isNull()))
