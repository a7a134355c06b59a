"""Secret scans over an incremental blob ledger.

A text is a blob, named by the SHA-256 of its UTF-8 bytes; every version of every document is a path to one. The ledger is a
Parquet folder, partitioned by rule version, with a row per (blob, rule version) that was scanned. A run scans only blobs that the ledger
has no row for under the present rule version, each once however many paths lead to it, appends them, and joins the
ledger's findings back to all paths. Findings are written before they are joined, so that Spark can split a blob of very many paths.

Defined cases: a null text is the empty blob; equal rows get equal results; an empty table gives an empty result; a ledger that does not
exist is empty; rows that it holds twice, as two runs may have added them, count once;
positions count code points of the whole text, end exclusive; other columns pass through `redact` and are not read by `scan`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import fresh, parts
from tessera.shared import exists, materialise

RULE_VERSION = "2026-1"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem")
COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: A maximal run of at least so many characters starts and ends where the plain run does, so short runs need no match of their own.
_RULES = {
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
}


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start and then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    for kind, rule in _RULES.items():
        found += [(m.start(), m.end(), kind) for m in rule.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in parts(batch, 1):
            found = [find_spans(t.as_py()) for t in some.column(1)]
            base = [[x for x in spans if x[2] in BASE] for spans in found]
            counts = [pa.array([sum(x[2] == kind for x in spans) for spans in base], pa.int64()) for kind in BASE]
            written = pa.array([sha256(_written(x).encode()).hexdigest() for x in base]), pa.array([_written(x) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([some.column(0), *counts, *written], ["blob", *COLUMNS])


def _text(text: str):
    return F.coalesce(F.col(text), F.lit(""))


FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def read_ledger(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame:
    """The ledger's rows under a rule version, one per blob."""
    if not exists(spark, ledger):
        return spark.createDataFrame([], FINDINGS)
    rows = spark.read.schema(f"{FINDINGS}, rule_version string").parquet(ledger)
    return rows.where(F.col("rule_version") == rule_version).drop("rule_version").dropDuplicates(["blob"])


def scan_unseen(docs: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of docs that the ledger lacks under this rule version, add them to it, and give all that it then holds under it."""
    spark = docs.sparkSession
    blobs = docs.select(F.sha2(_text(text), 256).alias("blob"), _text(text).alias("text"))
    if exists(spark, ledger):
        blobs = blobs.join(read_ledger(spark, ledger, rule_version).select("blob"), "blob", "left_anti")
    found = blobs.dropDuplicates(["blob"]).mapInArrow(_scan, FINDINGS)
    found.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    return read_ledger(spark, ledger, rule_version)


def scan(docs: DataFrame, ledger: str, paths: Sequence[str] = ("doc_id",), text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Per row of docs: its path (columns such as doc_id and version) and the findings in its text. The ledger grows by what it lacked."""
    rows = materialise(scan_unseen(docs, ledger, text, rule_version), "findings").select(*[F.col(c).alias(f"found.{c}") for c in ("blob", *COLUMNS)])
    named = docs.select(*[F.col(c) for c in paths], F.sha2(_text(text), 256).alias("found.path"))
    found = named.join(rows.hint("merge"), F.col("`found.path`") == F.col("`found.blob`"))
    return found.select(*paths, *[F.col(f"`found.{c}`").alias(c) for c in COLUMNS])


def redacted(text: str, spans: str) -> str:
    """text with each stretch of findings replaced by the kind of its first one."""
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",")):
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """docs with its findings written over, blobs that the ledger lacks scanned first; n_chars, where there is one, follows the new text."""
    names, at = docs.columns, docs.columns.index(text)
    blob, spans = fresh(names, "blob"), fresh(names, "spans")
    found = materialise(scan_unseen(docs, ledger, text, rule_version).where("spans != ''").select("blob", "spans"), "findings")
    found = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)).hint("merge")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, at):
                new = [t if not s else redacted(t, s) for t, s in zip(some.column(at).to_pylist(), some.column(len(names)).to_pylist(), strict=True)]
                columns = some.columns[: len(names)]
                columns[at] = pa.array(new, some.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.withColumn(blob, F.sha2(_text(text), 256)).join(found, blob, "left").select(*names, spans)
    out = keyed.mapInArrow(written, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in names else out
