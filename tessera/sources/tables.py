"""Driver tables as the canonical tables of the model: messages, evidence, memories, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Origins a piece of evidence may have; the first four count as real ones. Fixed values.
ORIGINS = (
    "REAL_USER_MESSAGE", "USER_SELF_REPORT", "USER_CORRECTION", "AUTHORIZED_IMPORT", "USER_CHOSEN_DIRECTIVE",
    "EXTERNAL_SKILL_DATA", "MODEL_INFERENCE", "SIMULATED_DIALOGUE", "SIMULATION_FEEDBACK", "EVALUATION_PRIVATE",
)
REAL_ORIGINS = ORIGINS[:4]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chat messages; deletion, reply state and consent are derived from the keys."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return turns.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("sequence"),
        F.when(F.col("role") == "user", "USER").otherwise("AGENT").alias("speaker"),
        "text",
        (F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(13)) == 0).alias("deleted"),
        F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 0, "WAITING").when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) == 1, "FAILED").otherwise("REPLIED").alias("reply_state"),
        F.when(F.pmod("turn", F.lit(4)) != 0, "work").alias("request_domain"),
        F.when(F.pmod("turn", F.lit(3)) != 0, F.pmod("turn", F.lit(3)) == 1).alias("remember_requested"),
    )


MESSAGES = """messages AS (
  SELECT conv_id AS conversation_id, turn AS sequence, CASE WHEN role = 'user' THEN 'USER' ELSE 'AGENT' END AS speaker, text,
    (conv_id * 31 + turn * 7) % 13 = 0 AS deleted,
    CASE (conv_id + turn) % 5 WHEN 0 THEN 'WAITING' WHEN 1 THEN 'FAILED' ELSE 'REPLIED' END AS reply_state,
    CASE WHEN turn % 4 <> 0 THEN 'work' END AS request_domain,
    CASE WHEN turn % 3 <> 0 THEN turn % 3 = 1 END AS remember_requested
  FROM conversations WHERE role <> 'system')"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as evidence; a toxic label stands for a deletion, its lack for no review."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    origin = F.element_at(F.array(*map(F.lit, ORIGINS)), (F.pmod("doc_id", F.lit(10)) + 1).cast("int"))
    status = F.when(F.col("toxic") == 1, "DELETED").when(F.pmod("doc_id", F.lit(7)) == 0, "PENDING").otherwise("ACTIVE")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("owner_id"), F.col("lang").alias("domain"), "text", origin.alias("origin"), status.alias("status"), F.when(F.pmod("doc_id", F.lit(6)) != 0, "granted").alias("consent_scope")
    )


EVIDENCE = f"""evidence AS (
  SELECT d.doc_id AS id, source AS owner_id, lang AS domain, text, [{", ".join(f"'{x}'" for x in ORIGINS)}][CAST(d.doc_id % 10 AS INT) + 1] AS origin,
    CASE WHEN toxic = 1 THEN 'DELETED' WHEN d.doc_id % 7 = 0 THEN 'PENDING' ELSE 'ACTIVE' END AS status,
    CASE WHEN d.doc_id % 6 <> 0 THEN 'granted' END AS consent_scope
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a usage ledger: whole tokens, seconds since the epoch, the payload's k."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("us"), F.floor("value").cast("long").alias("tokens"), F.get_json_object("props", "$.k").cast("int").alias("k"), "props"
    )


LEDGER = """ledger AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS tokens, CAST(json_extract(props, '$.k') AS INT) AS k, props FROM events)"""
