"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_runs, mixing, neardup, oracles, prefix_trie, quality, resample, secrets, spans, token_counts, toxicity, warc, webp
from tessera.shared import new_path, spread

UNIGRAM_PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Target weights of the mixing query: domain, language, source.
_LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.1, mixing.OTHER: 0.05}
WEIGHTS = {
    "bulk": {"": 0.25, **_LANGUAGES},
    "curated": {"": 0.75, **{lang: {"": w, **{f"src{i}": 1 + (i % 3) for i in range(1, 20)}, mixing.OTHER: 1} for lang, w in _LANGUAGES.items()}},
}


def mixing_levels() -> list:
    return [F.when(F.col("source") == "src0", "bulk").otherwise("curated"), F.col("lang"), F.col("source")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def secrets_ledger(spark: SparkSession) -> str:
    """Where the ledger of secret scans is kept between runs: the session's spark.tessera.secrets.ledger; where that is unset, a new one."""
    return spark.conf.get("spark.tessera.secrets.ledger", None) or new_path(spark, "secrets")


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.round_trip(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(_table(spark, sf_dir, "documents"), windows=True)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets_ledger(spark))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), UNIGRAM_PIECES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    planned = mixing.plan(docs, WEIGHTS, mixing_levels(), fraction=0.6, max_epochs=2, seed=17)
    sized = docs.select("doc_id", "lang", "source", mixing.words_of(F.col("text")).alias("n_tokens"), planned.leaf.alias("leaf"))
    return sized.withColumn("times", planned.times(F.col("doc_id"), F.col("n_tokens")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_runs.dedup_lines(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_webp, op2_near_duplicates, op3_toxicity, op4_repeated_spans, op5_byte_bpe, op6_secrets, op7_token_counts, op8_mixing, op9_quality, op10_warc, op11_resampling, op12_line_dedup, op13_prefix_trie, pipeline)}


#: The other queries rest on hashes, models or codecs that SQL lacks; tests hold those against brute force.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": WARC_SQL, "op11_resampling": oracles.RESAMPLING, "op12_line_dedup": oracles.LINES, "op13_prefix_trie": oracles.TRIE}
