"""File sources and sinks: JSON documents, provider payloads, backups with checksums."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
RECORD = T.StructType([T.StructField(n, _TEXT) for n in ("id", "kind", "owner_id", "session_id", "split", "occurred_at", "subject_id", "source_origin", "consent_purpose", "content", "domain", "choice", "question")])
RECORD = RECORD.add("reasons", _TEXTS).add("options", _TEXTS).add("reference", T.StructType([T.StructField("choice", _TEXT), T.StructField("reasons", _TEXTS)]))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Records of an evaluation file (one JSON document with a list `records`)."""
    whole = spark.read.schema(T.StructType([T.StructField("records", T.ArrayType(RECORD))])).option("multiLine", True).json(path)
    return whole.select(F.inline("records"))


def latest(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """An upsert log's present rows: the last per key."""
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(key).agg(F.max_by(row, F.struct(*map(F.col, order))).alias("_row")).select("_row.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name (with the folders below path), bytes and SHA-256 of every file below path."""
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "", path.rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", f"\\Q{folder}/\\E", 2), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def restore_faults(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a backup that are missing, changed or not in its manifest."""
    both = recorded.alias("r").join(found.alias("f"), "name", "full")
    fault = F.when(F.col("f.sha256").isNull(), "MISSING").when(F.col("r.sha256").isNull(), "UNLISTED").when(F.col("r.sha256") != F.col("f.sha256"), "CHANGED")
    return both.select("name", fault.alias("fault")).where("fault is not null")


def search_results(payloads: DataFrame, provider: str = "provider", payload: str = "payload") -> DataFrame:
    """provider, pos, url, title, excerpt: the first 50 items of each answer that have an address, whatever field the provider keeps them in."""
    item = "array<struct<url: string, link: string, title: string, name: string, content: string, snippet: string, summary: string>>"
    shape = f"results {item}, items {item}, data struct<webPages: struct<value: {item}>>, organic {item}"
    parsed = payloads.withColumn("p", F.from_json(payload, shape))
    items = F.coalesce("p.results", "p.items", "p.data.webPages.value", "p.organic")
    rows = parsed.select(provider, F.posexplode(items).alias("pos", "x")).where("pos < 50")
    return rows.select(provider, "pos", F.coalesce("x.url", "x.link").alias("url"), F.coalesce("x.title", "x.name").alias("title"), F.coalesce("x.content", "x.snippet", "x.summary").alias("excerpt")).where("url <> ''")
