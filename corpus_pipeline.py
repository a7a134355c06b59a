"""From raw documents to training tokens, in five stages, each written as Parquet and read again by the next.

Quality rules drop bad documents; near-duplicates leave one document of each group; findings of the secret scan are
written over; mixing takes sources by target weights; byte-level BPE gives token ids and proves that they decode.

Defined cases: null and empty texts, and whatever the quality rules reject, go in the first stage; repeats of a row, and rows near to one another, leave the one with the smallest doc_id; rows
without a doc_id are near to nothing and stay; a null language or source belongs to the leaf for others; texts of any length are taken whole; columns beside those of documents pass through
all stages but the last, whatever they are called, and are not in its result; an empty table gives an empty result. Each stage is written before the next reads it, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, neardup, quality, registry, secrets
from tessera.shared import materialise


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs, words=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, registry.secrets_ledger(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, registry.WEIGHTS, registry.mixing_levels(), fraction=0.8, max_epochs=1, seed=17)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(docs, registry.VOCABULARY, public_tokenizers.PATTERN), registry.VOCABULARY)
    return both.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", drop_bad),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Shingle signatures, EM and merges are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
