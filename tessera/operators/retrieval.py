"""Retrieval: lexical, BM25 and dense channels, their fusion, packing into a context, sources and caches.

A question meets every document, but no (question, document) pair is shuffled: questions go to all tasks in blocks of bounded size, a
task scores each document from its own row and keeps the k best per question, and only those are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.shared import materialise, spread

BLOCK = 200_000  # terms, or numbers of vectors, of the questions of one block
SCOPED = 1_000_000  # the same where each question sees its owner's documents only
WORDS = 8  # of 64 bits, a bit for each of the terms that most of an owner's questions have
CELLS, TERMS = 200_000, 100_000  # pairs of a document and a question, and terms of documents, that are scored at a time
CHANNELS = "channel string, item_id long, doc_id long, score double"


def _top(scored: DataFrame, query: str, doc: str, score: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), doc))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def _blocks(queries: DataFrame, key: str, size: int) -> list[DataFrame]:
    """queries in parts of about BLOCK numbers in all, dealt by a hash of their key."""
    n = max(1, -(-size // BLOCK))
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else queries for i in range(n)]


class _Best:
    """The k best of each question: highest score, then smallest id. Scores of a batch come as a table of documents by questions, -inf where there is none."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        k = min(self.k, len(ids))
        least = np.maximum(np.partition(scores, len(ids) - k, axis=0)[len(ids) - k], self.scores[:, -1])  # what is under it has no place
        item, row = np.nonzero((scores >= least).T & np.isfinite(scores).T)
        self.put(item, scores[row, item], ids[row])

    def put(self, item: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some pairs: the question's place, the score, the document's id."""
        order = np.lexsort((ids, -found, item))
        item, found, ids = item[order], found[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        item, found, ids, place = (x[place < self.k] for x in (item, found, ids, place))
        some, row = np.unique(item, return_inverse=True)
        more, which = np.full((len(some), self.k), -np.inf), np.full((len(some), self.k), np.iinfo(np.int64).max)
        more[row, place], which[row, place] = found, ids
        scores, which = np.hstack([self.scores[some], more]), np.hstack([self.ids[some], which])
        order = np.lexsort((which, -scores), axis=1)[:, : self.k]
        self.scores[some], self.ids[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(which, order, 1)

    def batch(self, items: np.ndarray, channel: str) -> pa.RecordBatch:
        item, place = np.nonzero(np.isfinite(self.scores))
        columns = pa.array([channel] * len(item), pa.string()), pa.array(items[item]), pa.array(self.ids[item, place]), pa.array(self.scores[item, place])
        return pa.RecordBatch.from_arrays(list(columns), ["channel", "item_id", "doc_id", "score"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1)
        starts, codes = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
        found = [np.unique(codes[a:b], return_counts=True) for a, b in zip(starts[:-1], starts[1:])]
        lists = pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts).astype(np.int64)), *lists], ["doc_id", "len", "terms", "tf"])


def term_hashes(text: Column, words: Callable[[Column], Column] = X.words) -> Column:
    """The distinct terms of a text as sorted 64-bit hashes, none of a null."""
    return F.coalesce(F.sort_array(F.transform(F.array_distinct(words(text)), lambda w: F.xxhash64(w))), F.array().cast("array<long>"))


def term_table(docs: DataFrame, words: Callable[[Column], Column] = X.words) -> DataFrame:
    """doc_id, len, and the distinct terms of each document, as 64-bit hashes, with their counts; written once, however many questions meet it."""
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    rows = spread(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(hashed, F.array().cast("array<long>")).alias("w"))
    return materialise(rows.mapInArrow(_counted, "doc_id long, len long, terms array<long>, tf array<long>"), "terms")


def _places(terms: pa.ListArray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the documents' terms the document's place, the place among the known terms, and whether it is one of them."""
    flat = terms.flatten().to_numpy()
    place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    return np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy())), place, known[place] == flat


def _hits(batch: pa.RecordBatch, known: np.ndarray, rows: int = 256) -> Iterator[tuple]:
    """For some documents at a time: their rows, and of their terms that are known, the document's place, the term's and the count."""
    for at in range(0, len(batch), rows):
        some = batch.slice(at, rows)
        doc, place, hit = _places(some.column(2), known)
        yield some, doc[hit], place[hit], some.column(3).flatten().to_numpy()[hit]


def _document_counts(index) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value[0]
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, term, _ in _hits(batch, known):
                counts += np.bincount(term, minlength=len(known))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["t", "n"])

    return of


def _ranked(index, weights, k: int, k1: float, b: float) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items, offsets, asks = index.value  # terms; questions; per term, which questions have it
        idf, mean = weights.value
        lexical, bm25 = _Best(len(items), k), _Best(len(items), k)
        for batch in batches:
            for some, doc, term, tf in _hits(batch, known):
                ids, size = some.column(0).to_numpy(), some.column(1).to_numpy()
                each = offsets[term + 1] - offsets[term]
                total = int(each.sum())
                first = np.repeat(offsets[term] - (np.cumsum(each) - each), each) + np.arange(total)
                cell = np.repeat(doc, each) * len(items) + asks[first]
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / mean))
                shared = np.bincount(cell, minlength=len(ids) * len(items)).reshape(len(ids), -1)
                score = np.round(np.bincount(cell, np.repeat(weight, each), len(ids) * len(items)), 6).reshape(len(ids), -1)
                able = shared > 0
                lexical.add(np.where(able, shared, -np.inf), ids)
                bm25.add(np.where(able, score, -np.inf), ids)
        yield lexical.batch(items, "lexical")
        yield bm25.batch(items, "bm25")

    return of


def channels(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, words: Callable[[Column], Column] = X.words) -> DataFrame:
    """channel, item_id, doc_id, score and place of the k best documents of each question: by shared distinct terms ("lexical") and by BM25.

    queries: item_id, text; docs: doc_id, text. Words are compared by 64-bit hashes. Texts are read once into tables of terms; that of the documents is read twice by each block
    of questions, for the numbers of documents and for the scores. Rows without an id are left out; a question without words finds nothing.
    """
    spark = queries.sparkSession
    asked = materialise(queries.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(term_hashes(F.col("text"), words)).alias("h")), "asked")
    table = term_table(docs, words)
    n_docs, mean = table.agg(F.count(F.lit(1)), F.avg("len")).first()
    best = spark.createDataFrame([], CHANNELS)
    for block in _blocks(asked, "item_id", asked.count()):
        rows = block.toArrow()  # about BLOCK rows
        known, term = np.unique(rows["h"].to_numpy(), return_inverse=True)
        items, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
        if not len(items):
            continue
        order = np.argsort(term, kind="stable")
        index = spark.sparkContext.broadcast((known, items, np.searchsorted(term[order], np.arange(len(known) + 1)), item[order]))
        found = table.mapInArrow(_document_counts(index), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the block
        df = np.zeros(len(known))
        df[found["t"].to_numpy()] = found["n"].to_numpy()
        weights = spark.sparkContext.broadcast((np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), mean or 1.0))
        best = best.unionByName(table.mapInArrow(_ranked(index, weights, k, k1, b), CHANNELS))
    place = F.row_number().over(Window.partitionBy("channel", "item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def _scoped_index(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Questions sorted by owner and time, and their terms by owner: an owner's frequent terms as bits of its questions, of the others which questions have them."""
    _, first, item = np.unique(rows["item_id"].to_numpy(), return_index=True, return_inverse=True)
    items, owner, before = (rows[c].to_numpy()[first] for c in ("item_id", "owner", "at"))
    order = np.lexsort((before, owner))
    items, before, item = items[order], before[order], np.argsort(order)[item]
    owners, low, nth = np.unique(owner[order], return_index=True, return_inverse=True)
    order = np.lexsort((item, rows["h"].to_numpy(), nth[item]))
    item, h = item[order], rows["h"].to_numpy()[order]
    new = np.append(True, (np.diff(h) != 0) | (np.diff(nth[item]) != 0))
    term, whose, known = np.cumsum(new) - 1, nth[item[new]], h[new]
    vocabulary = np.searchsorted(whose, np.arange(len(owners) + 1))  # where each owner's known terms begin
    words = max(1, min(WORDS, 4 * SCOPED // len(items)))
    by_count = np.lexsort((-np.bincount(term), whose))
    rank = np.empty(len(known), np.int64)
    rank[by_count] = np.arange(len(known)) - vocabulary[whose[by_count]]
    bit = np.where(rank < 64 * words, rank, -1)
    often = bit[term] >= 0
    bits = np.zeros((words, len(items)), np.uint64)
    np.bitwise_or.at(bits, (bit[term[often]] // 64, item[often]), np.uint64(1) << (bit[term[often]] % 64).astype(np.uint64))
    offsets = np.searchsorted(term[~often], np.arange(len(known) + 1))
    return items, before, owners, np.append(low, len(items)), vocabulary, known, bit, bits, offsets, item[~often]


def _earlier(index, k: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, before, owners, bounds, vocabulary, known, bit, bits, offsets, asks = index.value
        best = _Best(len(items), k)
        for batch in batches:
            ids, owner, at = (batch.column(c).to_numpy() for c in range(3))
            sizes = batch.column(3).offsets.to_numpy()
            ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(batch))
            x = 0
            while x < len(batch):  # rows of one owner, as many as CELLS and TERMS allow
                end, o = ends[np.searchsorted(ends, x, "right")], np.searchsorted(owners, owner[x])
                start = high = 0
                if o < len(owners) and owners[o] == owner[x]:
                    low, high = bounds[o], bounds[o + 1]
                    start = low + np.searchsorted(before[low:high], at[x:end].min(), "right")
                if start == high:  # no one asks later
                    x = end
                    continue
                width = high - start
                y = min(end, max(x + 1, min(x + CELLS // width, np.searchsorted(sizes, sizes[x] + TERMS, "right") - 1)))
                doc, term, hit = _places(batch.column(3).slice(x, y - x), known[vocabulary[o] : vocabulary[o + 1]])
                doc, term = doc[hit], term[hit] + vocabulary[o]
                often = bit[term] >= 0
                has = np.zeros((y - x, 64 * len(bits)), bool)
                has[doc[often], bit[term[often]]] = True
                mine = np.packbits(has, axis=1, bitorder="little").view("<u8")
                doc, term = doc[~often], term[~often]
                each = offsets[term + 1] - offsets[term]
                found = asks[np.repeat(offsets[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                cell = np.repeat(doc * width, each) + (found - start)
                shared = np.bincount(cell[found >= start] if start > low else cell, minlength=(y - x) * width).reshape(y - x, width)
                for w in range(len(bits)):
                    shared += np.bitwise_count(mine[:, w, None] & bits[w, start:high])
                row, item = np.nonzero(shared >= np.maximum(best.scores[start:high, -1], 1))  # what is under it has no place
                sees = at[x + row] < before[start + item]
                row, item = row[sees], item[sees]
                best.put(start + item, shared[row, item].astype(float), ids[x + row])
                x = y
        yield best.batch(items, "lexical")

    return of


def most_shared(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """channel, item_id, doc_id, score and place of the k documents that share most distinct terms with each question, at least one, of those of its owner from strictly before it.

    queries: item_id, owner_id, occurred, terms; docs: doc_id, owner_id, occurred, terms, both written already, with the terms of `term_hashes`. Blocks are ranges of owners and times: a block reads its owners'
    documents from before its last question, and a document meets its owner's later questions only, which lie side by side. Documents that are sorted so within their
    files are scored together. Rows without an id, an owner or a time see nothing and are not seen.
    """
    spark = queries.sparkSession
    scope = [F.xxhash64("owner_id").alias("owner"), F.col("occurred").cast("long").alias("at")]
    whole = lambda rows, key: rows.where(F.col(key).isNotNull() & F.col("owner_id").isNotNull() & F.col("occurred").isNotNull()).select(F.col(key).cast("long").alias(key), *scope, "terms")
    table = whole(docs, "doc_id")
    asked = whole(queries, "item_id").select("item_id", "owner", "at", F.explode("terms").alias("h"))
    n = max(1, -(-asked.count() // SCOPED))
    if n > 1:
        asked = materialise(asked.repartitionByRange(n, "owner", "at", "item_id").withColumn("block", F.spark_partition_id()), "asked", by="block")
    best = spark.createDataFrame([], CHANNELS)
    for i in range(n):
        rows = (asked.where(F.col("block") == i) if n > 1 else asked).toArrow()  # about SCOPED rows
        if not rows.num_rows:
            continue
        index = _scoped_index(rows)
        last, owners = int(index[1].max()), index[2]
        near = table.where(F.col("owner").between(int(owners[0]), int(owners[-1])) & (F.col("at") < last))
        best = best.unionByName(near.mapInArrow(_earlier(spark.sparkContext.broadcast(index), k), CHANNELS))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def lexical(queries: DataFrame, docs: DataFrame, k: int = 2) -> DataFrame:
    """The k documents that share most distinct terms with each query. queries: item_id, text; docs: doc_id, text."""
    found = channels(queries, docs, k).where("channel = 'lexical'")
    return found.select("item_id", "doc_id", F.col("score").cast("long").alias("overlap"), "place")


def bm25(queries: DataFrame, docs: DataFrame, k: int = 3, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents by BM25, scores rounded to six places."""
    return channels(queries, docs, k, k1, b).where("channel = 'bm25'").select("item_id", "doc_id", "score", "place")


def _nearest(block, k: int) -> Callable:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, own, asked = block.value
        best = _Best(len(items), k)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                ids = some.column(0).to_numpy(zero_copy_only=False)
                wide = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                norms = np.sqrt((wide * wide).sum(axis=1))
                norms[norms == 0] = np.nan  # no direction: near to nothing
                scores = np.round(wide @ asked.T / norms[:, None], 6)
                scores[np.isnan(scores) | (ids[:, None] == own[None, :])] = -np.inf
                best.add(scores, ids)
        yield best.batch(items, "dense")

    return of


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(channel, item_id, doc_id, score, place) of the k vectors nearest to each question by cosine.

    vectors: doc_id, embedding; asked: item_id, own (the vector that is the question's own and is passed over; null if none), embedding. Questions come in blocks.
    Only vectors of the length that the questions have are comparable; the others, and those that are null, empty or hold a null, are left out. Questions of
    different lengths are refused.
    """
    spark = vectors.sparkSession
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())
    asked = asked.where(whole).where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("own").cast("long"), F.lit(-(2**63))).alias("own"), "embedding")
    n, least, size = asked.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != size:
        raise ValueError(f"questions have vectors of {least} to {size} numbers")
    wide = vectors.where(whole & (F.size("embedding") == F.lit(size or 0))).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "embedding")
    best = spark.createDataFrame([], CHANNELS)
    for block in _blocks(asked, "item_id", n * (size or 0)):
        rows = block.toArrow()  # about BLOCK numbers
        if rows.num_rows:
            q = np.array(rows["embedding"].to_pylist(), float)
            with np.errstate(invalid="ignore"):
                q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
            best = best.unionByName(wide.mapInArrow(_nearest(spark.sparkContext.broadcast((rows["item_id"].to_numpy(), rows["own"].to_numpy(), q)), k), CHANNELS))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def dense(vectors: DataFrame, queries: Column, k: int = 3) -> DataFrame:
    """The k nearest others by cosine for the rows that `queries` picks, a stated query set met by all rows. See `nearest` for vectors of other lengths."""
    asked = vectors.where(queries).select(F.col("vec_id").alias("item_id"), F.col("vec_id").alias("own"), "embedding")
    found = nearest(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), asked, k)
    return found.select("item_id", F.col("doc_id").alias("vec_id"), "score", "place")


def fused(channels: list[DataFrame], k: int = 3, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of channels with item_id, doc_id, place."""
    rows = channels[0].select("item_id", "doc_id", "place")
    for c in channels[1:]:
        rows = rows.unionByName(c.select("item_id", "doc_id", "place"))
    scored = rows.groupBy("item_id", "doc_id").agg(F.round(F.sum(1 / (constant + F.col("place"))), 9).alias("score"))
    return _top(scored, "item_id", "doc_id", "score", k)


#: Weights of the six parts of a memory's final score, and what multiplies it where it is no longer in force.
PARTS = {"semantic": 0.3, "keyword": 0.25, "recency": 0.15, "importance": 0.1, "temporal": 0.1, "status": 0.1}
DAMPED = {"ACTIVE": 1.0, "REINFORCED": 1.0, "CANDIDATE": 0.8, "SUPERSEDED": 0.4, "ARCHIVED": 0.3}


def recalled(lists: list[DataFrame], memories: DataFrame, at: Column, k: int = 3, half_life: float = 90.0, margin: float = 0.0, constant: int = 60) -> DataFrame:
    """Fusion of channels by reciprocal ranks, weighed again by six parts, with an explicit answer where nothing is sure enough.

    lists: item_id, doc_id, place, and channel and score, of which "dense" scores are the semantic part and "lexical" ones, as a share of the item's best, the keyword part;
    a channel that is missing counts 0. memories: doc_id, occurred, valid_from, valid_to (null: open), importance (0 to 1), status; `at` is the time of asking, in the unit of
    `occurred`. Memories that are deleted or of which nothing is known drop out; superseded and archived ones are damped, not removed. Returned are item_id, place, doc_id,
    score; an item whose best score is not more than `margin` above the next one's has one row, without doc_id and place. Items that no channel lists have none, as
    they are not known here: see `abstaining`.
    """
    rows = lists[0].select("channel", "item_id", "doc_id", "score", "place")
    for c in lists[1:]:
        rows = rows.unionByName(c.select("channel", "item_id", "doc_id", "score", "place"))
    of = lambda channel: F.coalesce(F.max(F.when(F.col("channel") == channel, F.col("score"))), F.lit(0.0))
    pairs = rows.groupBy("item_id", "doc_id").agg(F.sum(1 / (constant + F.col("place"))).alias("rrf"), of("dense").alias("semantic"), of("lexical").alias("overlap"))
    top = pairs.groupBy("item_id").agg(F.max("rrf").alias("most_rrf"), F.max("overlap").alias("most_overlap"))
    known = pairs.join(memories.where("status <> 'DELETED'"), "doc_id").join(top, "item_id")
    damp = F.coalesce(*[F.when(F.col("status") == s, w) for s, w in DAMPED.items()], F.lit(0.0))
    parts = {
        "semantic": F.greatest(F.col("semantic"), F.lit(0.0)),
        "keyword": F.when(F.col("most_overlap") > 0, F.col("overlap") / F.col("most_overlap")).otherwise(0.0),
        "recency": F.pow(F.lit(0.5), F.greatest(at - F.col("occurred"), F.lit(0)) / half_life),
        "importance": F.coalesce("importance", F.lit(0.0)),
        "temporal": F.coalesce((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))), F.lit(False)).cast("double"),
        "status": damp,
    }
    weighed = sum((F.lit(w) * parts[name] for name, w in PARTS.items()), F.lit(0.0))
    scored = known.select("item_id", "doc_id", F.round(F.col("rrf") / F.col("most_rrf") * weighed * damp, 9).alias("score"))
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    placed = scored.withColumn("place", F.row_number().over(by_score)).withColumn("next", F.lead("score").over(by_score)).where(F.col("place") <= k)
    sure = F.first(F.when(F.col("place") == 1, F.col("score") - F.coalesce("next", F.lit(0.0)) > margin), ignorenulls=True).over(Window.partitionBy("item_id"))
    judged = placed.withColumn("sure", sure).where("sure or place = 1")
    return judged.select("item_id", F.when(F.col("sure"), F.col("place")).alias("place"), F.when(F.col("sure"), F.col("doc_id")).alias("doc_id"), F.when(F.col("sure"), F.col("score")).alias("score"))


def abstaining(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """answers with a row, all null but item_id, for each question that has none."""
    none = queries.select("item_id").distinct().join(answers.select("item_id"), "item_id", "left_anti")
    return answers.unionByName(none, allowMissingColumns=True)


def packed(ranked: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """Greedy packing in order: an entry that does not fit is left out and the next is tried."""
    rows = ranked.select(by, F.struct(F.col(order), F.col("doc_id"), size.cast("long").alias("size")).alias("x")).groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit("").alias("ids"))
    fold = F.aggregate(
        "xs",
        start,
        lambda a, x: F.when(
            a["used"] + x["size"] <= budget,
            F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["ids"], F.when(a["ids"] != "", F.lit(",")).otherwise(F.lit("")), x["doc_id"].cast("string")).alias("ids")),
        ).otherwise(a),
    )
    return rows.select(by, fold.alias("f")).select(by, F.col("f.used").alias("used"), F.col("f.ids").alias("packed"))


def official_first(pages: DataFrame) -> DataFrame:
    """Within each site, official hosts first, then by arrival."""
    found = pages.withColumn("host", X.host(F.col("url")))
    found = found.withColumn("authority", F.when(X.official(F.col("host")), "OFFICIAL_DOMAIN").otherwise("OTHER"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.col("authority") != "OFFICIAL_DOMAIN", "page_id"))
    return found.select("page_id", "host", "authority", place.alias("position"))


def fresh_hits(calls: DataFrame, seconds: int = 900) -> DataFrame:
    """Whether the last call with the same key is young enough to serve this one."""
    before = F.max("us").over(Window.partitionBy("user_id", "event_type").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    age = F.col("us") - before
    return calls.select("event_id", F.coalesce((age >= 0) & (age <= seconds * 1_000_000), F.lit(False)).alias("hit"))


def inherited(runs: DataFrame, wanted: DataFrame, published: DataFrame, sources: DataFrame, now: Column, seconds: int = 900, most: int = 12) -> DataFrame:
    """(run_id, from_run, url) of the sources that runs may take over from earlier ones: of the first `most` different runs they name, those of their own scope that were published and are in force, and of these
    the sources that are young enough.

    runs: run_id, scope_id, phase; wanted: run_id, from_run, place; published: run_id; sources: run_id, url, retrieved_at (seconds, like now). A run takes nothing from itself.
    """
    first = wanted.groupBy("run_id", "from_run").agg(F.min("place").alias("place"))
    named = first.withColumn("nth", F.row_number().over(Window.partitionBy("run_id").orderBy("place"))).where(F.col("nth") <= most)
    own = named.join(runs.select("run_id", "scope_id"), "run_id")
    able = runs.where(~F.col("phase").eqNullSafe("INVALIDATED")).join(published.select("run_id").distinct(), "run_id", "left_semi").select(F.col("run_id").alias("from_run"), "scope_id")
    young = sources.where((now - F.col("retrieved_at")).between(0, seconds)).select(F.col("run_id").alias("from_run"), "url")
    return own.where("run_id <> from_run").join(able, ["from_run", "scope_id"], "left_semi").join(young, "from_run").select("run_id", "from_run", "url")
