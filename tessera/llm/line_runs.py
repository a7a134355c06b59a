"""Line dedup over levelled sorted runs of line hashes.

A store of lines is a folder of runs. A run is a table bucketed and sorted by the hash of a line's key; it says of each key in how many
documents of its batches the key stands (`n`) and the largest document that holds it (`top`). Adding a batch of documents

1. hashes its lines and counts each key once a document, in the tasks first;
2. merge-anti-joins the runs: a row that a run already settles (the run alone counts enough documents, and none of the batch is larger)
   adds nothing and goes. The batch is shuffled once into the runs' buckets; the runs are read as they lie, without shuffle;
3. writes what is left as a run of level 0.

`fanout` runs of a level are compacted into one of the next, so a batch meets few runs however many came before. A manifest, itself a new
file, names the live runs and the batches in them: a run counts once it is named there, so a batch that failed or comes twice changes
nothing, and runs that were compacted can be deleted.

Which lines go is the sum over all runs: keys in at least `threshold` documents lose their lines in all documents but the largest.

Defined cases: a line's key is the line without ASCII white space at both ends, A-Z lowered; a null or empty text is one empty line; keys of fewer than `shortest` code
points never go; rows under one doc_id are one document, so its repeats count once and get equal results; rows without a doc_id are together one document, smaller than
all others; texts of any length are hashed in small steps, and one document's lines are the most that is gathered in one row; an empty table gives an empty
result; other columns are read neither by `dedup_lines` nor by `drop_lines`. Keys are 128-bit hashes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import parts
from tessera.shared import entries, exists, materialise, new_path, remove

THRESHOLD, SHORTEST = 5, 40
FANOUT, BATCHES = 3, 6
NO_ID = -(2**63)  # stands for a missing doc_id
RUN = "key binary, n long, top long"


def line_keys(text: str | None, shortest: int) -> tuple[list[str], np.ndarray, list[bytes]]:
    """The lines of a text, which of them are long enough, and the hashes of those, in order."""
    lines = (text or "").split("\n")
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(pa.array(lines, pa.large_string())))
    able = pc.greater_equal(pc.utf8_length(keys), shortest).to_numpy(zero_copy_only=False)
    return lines, able, [blake2b(k.encode(), digest_size=16).digest() for k in keys.filter(pa.array(able)).to_pylist()]


def _hashed(shortest: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 1):
                texts = some.column(1)
                lines = pc.split_pattern(pc.cast(pc.fill_null(texts, ""), pa.large_string()), "\n")
                owner = pc.list_parent_indices(lines)
                keys = pc.ascii_lower(pc.ascii_trim_whitespace(pc.list_flatten(lines)))
                able = pc.greater_equal(pc.utf8_length(keys), shortest)
                found = {}
                for i, k in zip(owner.filter(able).to_pylist(), keys.filter(able).to_pylist(), strict=True):
                    found[i, blake2b(k.encode(), digest_size=16).digest()] = None
                docs = some.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, pa.array([k for _, k in found], pa.binary())], ["doc_id", "key"])

    return of


def _dropped(shortest: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 1):
                n_lines, n_dropped, kept = [], [], []
                for text, gone in zip(some.column(1), some.column(2), strict=True):
                    text = text.as_py() or ""
                    if not gone.is_valid:
                        n_lines.append(text.count("\n") + 1)
                        n_dropped.append(0)
                        kept.append(text)
                        continue
                    lines, able, keys = line_keys(text, shortest)
                    gone = set(gone.as_py())
                    out = np.zeros(len(lines), bool)
                    out[able] = [k in gone for k in keys]
                    n_lines.append(len(lines))
                    n_dropped.append(int(out.sum()))
                    kept.append("\n".join(line for line, x in zip(lines, out.tolist(), strict=True) if not x))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return of


def lines_of(docs: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key) of the lines that are long enough, once a row of docs."""
    return docs.select(_id(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_hashed(shortest), "doc_id long, key binary")


def _id(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


class LineStore:
    """Levelled runs of line hashes in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, threshold: int = THRESHOLD, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.threshold, self.fanout = spark, folder, threshold, fanout
        self.version, self.runs, self.names = 0, [], []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = [int(e.rpartition("-")[2]) for e in entries(spark, folder) if e.startswith("manifest-") and exists(spark, f"{folder}/{e}/_SUCCESS")]
        if known:
            self.version = max(known)
            held = json.loads(spark.read.parquet(f"{folder}/manifest-{self.version}").first()["state"])
            self.runs, self.names, self.buckets = [tuple(r) for r in held["runs"]], held["names"], held["buckets"]

    def _publish(self, runs: list[tuple[int, str]], names: list[str]) -> None:
        state = json.dumps({"runs": runs, "names": names, "buckets": self.buckets})
        self.spark.createDataFrame([(state,)], "state string").coalesce(1).write.parquet(f"{self.folder}/manifest-{self.version + 1}")
        self.version, self.runs, self.names = self.version + 1, runs, names

    def _write(self, rows: DataFrame) -> str:
        """A new run, one sorted file a bucket at most."""
        name = f"run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # written by another session
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def add(self, lines: DataFrame, name: str) -> None:
        """Add a batch (doc_id, key) under a name; a name that is known adds nothing. All rows of a document belong in one batch."""
        if name in self.names:
            return
        batch = lines.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        for _, run in self.runs:
            settled = self._read(run).where(F.col("n") >= self.threshold).select("key", F.col("top").alias("known"))
            batch = batch.join(settled.hint("merge"), (batch["key"] == settled["key"]) & (settled["known"] >= batch["top"]), "left_anti")
        self._publish([*self.runs, (0, self._write(batch))], [*self.names, name])
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level <= max((at for at, _ in self.runs), default=-1):
            full = [run for run in self.runs if run[0] == level]
            if len(full) >= self.fanout:
                merged = self._write(self._summed(full))
                self._publish([run for run in self.runs if run not in full] + [(level + 1, merged)], self.names)
                for _, name in full:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                    remove(self.spark, f"{self.folder}/{name}")
            level += 1

    def _summed(self, runs: list[tuple[int, str]]) -> DataFrame:
        rows = self.spark.createDataFrame([], RUN)
        for _, name in runs:
            rows = rows.unionByName(self._read(name))
        return rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def close(self) -> None:
        """Take the runs out of the session's catalog; their files stay."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def repeated(self) -> DataFrame:
        """(key, top) of the keys whose lines go, in all documents but `top`."""
        return self._summed(self.runs).where(F.col("n") >= self.threshold).select("key", "top")


def _cut_points(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Ids that part docs into about equal batches; they need not be exact."""
    shares = [k / batches for k in range(1, batches)]
    found = docs.agg(F.percentile_approx(_id(id_col), shares, 1000)).first()[0] if shares else None
    return sorted(set(found or []))


def gone_keys(docs: DataFrame, store: LineStore, shortest: int = SHORTEST, batches: int = BATCHES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add docs to the store in batches by falling doc_id, so that a line that is settled is never added again; (doc_id, keys): what each document loses."""
    cuts = _cut_points(docs, id_col, batches)
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc_id") > cut).cast("int")
    lines = materialise(lines_of(docs, shortest, id_col, text).withColumn("batch", batch), "lines", by="batch")
    for k in range(len(cuts), -1, -1):
        store.add(lines.where(F.col("batch") == k).select("doc_id", "key"), f"batch-{k}")
    repeated = materialise(store.repeated(), "repeated")
    store.close()
    hit = lines.join(repeated, "key").where("doc_id <> top").select("doc_id", "key")
    return materialise(hit.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "gone")


def drop_lines(docs: DataFrame, gone: DataFrame, shortest: int = SHORTEST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_lines (before), n_dropped and kept, the text without the lines in gone (doc_id, keys)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), _id(id_col).alias("id"))
    both = rows.join(gone.select(F.col("doc_id").alias("id"), "keys").hint("merge"), "id", "left").select("doc_id", "text", "keys")  # merged at every size
    return both.mapInArrow(_dropped(shortest), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


def dedup_lines(docs: DataFrame, folder: str | None = None, threshold: int = THRESHOLD, shortest: int = SHORTEST, batches: int = BATCHES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_dropped and kept. folder: a store that begins empty; a new one if none is named."""
    store = LineStore(docs.sparkSession, folder or new_path(docs.sparkSession, "lines"), threshold)
    return drop_lines(docs, gone_keys(docs, store, shortest, batches), shortest)
