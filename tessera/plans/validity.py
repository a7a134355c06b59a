"""Queries on what drafts, research, permits and profiles rest on, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import validity as V
from tessera.sources.tables import EVIDENCE, LEDGER, MESSAGES, evidence, ledger, messages, table

DIMENSIONS, PROTOCOL, NOTICE = ("values", "style"), "p2", " (rights)"


def _messages(spark, d):
    return messages(spark, d).select((F.col("conversation_id") * 1000 + F.col("sequence")).alias("id"), "deleted")


def _sources(conversation):
    return F.array(conversation * 1000, conversation * 1000 + 2)


def retr_stale_runs(spark, d):
    """Events as research of their users, begun under older settings, epochs and versions, with two messages of a conversation each."""
    e, k = ledger(spark, d), F.col("k")
    phase = F.when(F.col("event_id") % 41 == 3, "CANCELLED").otherwise("READY")
    runs = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), phase.alias("phase"), F.when(k % 13 != 0, F.col("user_id") % 4).alias("config_revision"), F.when(k % 17 == 1, "old").otherwise("now").alias("binding"),
        (F.col("event_id") % 1500).alias("version_id"), (F.col("event_id") % 3).alias("privacy_revision"), _sources(F.col("event_id") % 400).alias("source_message_ids"),
    )
    now = e.select("user_id").distinct().select(F.col("user_id").alias("owner_id"), (F.col("user_id") % 4).alias("config_revision"), F.lit("now").alias("binding"), (F.col("user_id") % 3).alias("privacy_revision"))
    versions = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < -900, "INVALIDATED").otherwise("ACTIVE").alias("state"))
    return V.stale_runs(runs, now, versions, _messages(spark, d)).select("id", "reason")


def evid_batch_validity(spark, d):
    """Orders as drafts of replies: rooms are conversations, profiles customers, models nations, epochs the errors of a user."""
    key = F.col("o_orderkey")
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    epochs = ledger(spark, d).groupBy(F.col("user_id").alias("owner_id")).agg(F.count_if(F.col("event_type") == "error").alias("epoch"))
    batches = V.dealt_join(o.withColumn("u", F.col("o_custkey") % 100), epochs.select(F.col("owner_id").alias("u"), F.col("epoch").alias("was")), "u", "o_orderkey").select(
        key.alias("batch_id"), (F.col("o_custkey") % 100).alias("owner_id"), (key % 150).alias("conversation_id"), F.when(key % 3 == 0, key % 9000).alias("research_id"), (key % 26).alias("connection_id"),
        F.when(key % 23 != 0, F.concat(F.lit("m"), (key % 26 + (key % 19 == 0).cast("int")).cast("string"))).alias("model_hash"), (F.coalesce("was", F.lit(0)) - (key % 29 == 0).cast("int")).alias("privacy_revision"),
        F.col("o_custkey").alias("skill_id"), V.skill_version(F.col("c_name"), F.col("c_nationkey") - (key % 31 == 0).cast("int")).alias("skill_version"), _sources(key % 140).alias("source_message_ids"),
    )
    rooms = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("deleted", F.col("id") % 17 == 4)
    models = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("connection_id"), F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("hash"))
    skills = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < -500, "DISABLED").otherwise("ACTIVE").alias("status"), F.col("c_name").alias("text"), F.col("c_nationkey").alias("version"))
    stale = retr_stale_runs(spark, d).select("id", F.col("reason").isNotNull().alias("stale"))
    return V.batch_validity(batches, rooms, stale, models, epochs, skills, _messages(spark, d))


def _assessed(spark, d):
    """Orders as assessments of their customers' profiles."""
    key = F.col("o_orderkey")
    checks = F.map_from_arrays(F.array(*map(F.lit, V.CRITICAL)), F.array(*[key % n != 0 for n in (37, 41, 43, 47)]))
    return table(spark, d, "orders").select(
        key.alias("id"), key.alias("made"), F.col("o_custkey").alias("subject_id"), F.when(key % 6 == 0, "PERSONAL").otherwise("QUALITY").alias("kind"), F.when(key % 2 == 0, "USER_SKILL").when(key % 5 == 0, F.lit(None)).otherwise("SKILL_IMPORT").alias("subject_type"),
        (key % 7 != 0).alias("owner_confirmed"), F.when(key % 11 == 0, "FAILED").otherwise("PASSED").alias("status"), F.lit(PROTOCOL).alias("protocol"), F.when(key % 13 == 0, "p1").otherwise(PROTOCOL).alias("report_protocol"),
        (key % 17 != 0).alias("passed"), F.when(key % 19 == 0, "MOCK").otherwise("LIVE").alias("classification"), F.col("o_custkey").alias("report_version"), F.sha2(F.concat_ws(":", F.col("o_custkey").cast("string"), (key % 3 == 0).cast("string")), 256).alias("content_hash"),
        (key % 40 + 65).alias("overall"), F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(key % 50 + 60, key % 25 + 65)).alias("scores"), checks.alias("checks"), (key % 23 != 0).alias("all_live"), (key % 29 != 0).cast("string").alias("frozen_hash"),
    ).withColumn("report_hash", F.col("content_hash"))


def evid_self_admission(spark, d):
    c = table(spark, d, "customer")
    profiles = c.select(F.col("c_custkey").alias("id"), F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit("false")), 256).alias("hash"), F.lit("true").alias("frozen_hash"), (F.col("c_acctbal") > -800).alias("fine"))
    return V.admitted(_assessed(spark, d), profiles, DIMENSIONS, PROTOCOL)


def evid_quality_ready(spark, d):
    drafts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.sha2(F.concat_ws(":", F.col("c_custkey").cast("string"), F.lit("true")), 256).alias("hash"), F.col("c_custkey").alias("version"))
    return V.quality_ready(drafts, _assessed(spark, d))


def evid_unlocked(spark, d):
    """Order lines as permits of their suppliers, which rest on documents and on the assessments of orders."""
    line, n = table(spark, d, "lineitem").distinct(), F.col("l_suppkey")
    grants = line.select(
        F.xxhash64(*line.columns).alias("id"), n.alias("owner_id"), F.when(F.col("l_returnflag") == "R", "INVALIDATED").otherwise("ACTIVE").alias("status"), F.lit(PROTOCOL).alias("protocol"), F.col("l_partkey").alias("profile_id"),
        F.lit("h").alias("content_hash"), F.col("l_orderkey").alias("assessment_id"), (F.col("l_linenumber") % 3).alias("model_hash"), F.array(F.col("l_partkey") % 500, F.col("l_partkey") % 300).alias("evidence_ids"), F.col("l_orderkey").alias("made"),
    )
    profiles = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, "ACTIVE").alias("status"), F.when(F.col("p_size") % 7 == 0, "other").otherwise("h").alias("hash"))
    fine = evidence(spark, d).select("id", ((F.col("status") == "ACTIVE") & F.col("consent_scope").isNotNull()).alias("fine"))
    judged = V.valid_grants(grants, profiles, _assessed(spark, d).select("id", "status", "passed"), fine, PROTOCOL)
    models = table(spark, d, "supplier").select(F.col("s_suppkey").alias("owner_id"), (F.col("s_suppkey") % 3).cast("int").alias("hash"))
    best = V.unlocked(judged, models)
    return best.join(judged.select(F.col("id").alias("grant_id"), "made"), "grant_id").select("owner_id", "made")


def evid_upgrades(spark, d):
    """Parts as shipped profiles, some of them changed by hand; predecessors are those of an even size."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    text = F.concat(F.col("p_name"), F.when(key % 5 == 0, " (mine)").otherwise(""))
    existing = p.select(key.alias("id"), F.col("p_name").alias("slug"), F.lit("s1").alias("source_version"), (key % 7 != 0).alias("builtin"), F.col("p_size").alias("version"), text.alias("text"), F.when(key % 3 == 0, F.concat(F.lit("free"), F.lit(NOTICE))).otherwise("free").alias("permission"))
    packaged = p.where("p_size < 40").select(key.alias("id"), F.col("p_name").alias("slug"), F.lit("s1").alias("source_version"), F.lit(100).alias("version"), F.lit("new text").alias("text"))
    before = p.where("p_size % 2 = 0").select(key.alias("id"), F.col("p_size").alias("version"), F.sha2("p_name", 256).alias("text_hash"))
    return V.upgrades(existing, packaged, before, NOTICE)


STALE = f"""{LEDGER}, {MESSAGES}, gone AS (SELECT conversation_id * 1000 + sequence AS id FROM messages WHERE deleted), known AS (SELECT conversation_id * 1000 + sequence AS id FROM messages),
      st AS (SELECT event_id AS id, CASE WHEN event_id % 41 = 3 THEN 'STOPPED' WHEN k % 13 = 0 THEN 'SETTINGS' WHEN k % 17 = 1 THEN 'CONNECTION' WHEN c_acctbal < -900 THEN 'VERSION'
        WHEN event_id % 3 <> user_id % 3 AND (event_id % 400 * 1000 IN (SELECT id FROM gone) OR event_id % 400 * 1000 + 2 IN (SELECT id FROM gone)) THEN 'SOURCES' END AS reason FROM ledger LEFT JOIN customer ON c_custkey = event_id % 1500)"""
ASSESSED = """t AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 11 <> 0 AS ok, o_orderkey % 17 <> 0 AS passed, CAST(o_orderkey % 3 = 0 AS VARCHAR) AS third FROM orders)"""
SQL = {
    "retr_stale_runs": f"WITH {STALE} SELECT id, reason FROM st",
    "evid_batch_validity": f"""WITH {STALE}, b AS (SELECT o_orderkey AS k, o_custkey, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey)
      SELECT k AS batch_id, CASE WHEN k % 150 NOT IN (SELECT conv_id FROM conversations) OR k % 150 % 17 = 4 THEN 'ROOM' WHEN k % 3 = 0 AND (st.id IS NULL OR reason IS NOT NULL) THEN 'RESEARCH' WHEN k % 23 <> 0 AND (k % 26 = 25 OR k % 19 = 0) THEN 'MODEL'
        WHEN k % 29 = 0 THEN 'EPOCH' WHEN c_acctbal < -500 OR k % 31 = 0 THEN 'SKILL'
        WHEN k % 140 * 1000 NOT IN (SELECT id FROM known) OR k % 140 * 1000 + 2 NOT IN (SELECT id FROM known) OR k % 140 * 1000 IN (SELECT id FROM gone) OR k % 140 * 1000 + 2 IN (SELECT id FROM gone) THEN 'SOURCES' END AS deny_reason
      FROM b LEFT JOIN st ON k % 3 = 0 AND st.id = k % 9000""",
    "evid_self_admission": f"""WITH {ASSESSED} SELECT c AS subject_id, max(k) AS assessment_id FROM t JOIN customer ON c_custkey = c
      WHERE k % 6 <> 0 AND k % 2 = 0 AND k % 7 <> 0 AND ok AND k % 13 <> 0 AND passed AND k % 19 <> 0 AND k % 40 + 65 >= 80 AND k % 50 + 60 >= 70 AND k % 25 + 65 >= 70 AND k % 37 <> 0 AND k % 41 <> 0 AND k % 43 <> 0 AND k % 47 <> 0
        AND k % 23 <> 0 AND k % 29 <> 0 AND third = 'false' AND c_acctbal > -800 GROUP BY c""",
    "evid_quality_ready": f"""WITH {ASSESSED} SELECT c_custkey AS id, max(k) AS assessment_id FROM customer LEFT JOIN t ON c = c_custkey AND third = 'true' AND k % 6 <> 0 AND k % 2 <> 0 AND ok AND passed AND k % 19 <> 0 GROUP BY c_custkey""",
    "evid_unlocked": f"""WITH {EVIDENCE}, {ASSESSED}, f AS (SELECT id FROM evidence WHERE status = 'ACTIVE' AND consent_scope IS NOT NULL)
      SELECT l_suppkey AS owner_id, max(l_orderkey) AS made FROM lineitem JOIN part ON p_partkey = l_partkey JOIN t ON k = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
      WHERE l_returnflag <> 'R' AND p_size % 7 <> 0 AND ok AND passed AND l_linenumber % 3 = l_suppkey % 3 AND l_partkey % 500 IN (SELECT id FROM f) AND l_partkey % 300 IN (SELECT id FROM f) GROUP BY l_suppkey""",
    "evid_upgrades": f"""WITH p AS (SELECT *, p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_size < 40 AND p_size % 2 = 0 AS up, 'free' || CASE WHEN p_partkey % 3 = 0 THEN '{NOTICE}' ELSE '' END AS permission FROM part)
      SELECT p_partkey AS id, p_name AS slug, CASE WHEN up THEN 100 ELSE p_size END AS version, CASE WHEN up THEN 'new text' ELSE p_name || CASE WHEN p_partkey % 5 = 0 THEN ' (mine)' ELSE '' END END AS text,
        CASE WHEN up AND p_partkey % 3 <> 0 THEN permission || '{NOTICE}' ELSE permission END AS permission, up AS upgraded FROM p""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("evid_", "retr_"))]
