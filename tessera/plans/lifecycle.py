"""Queries over the life of evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evidence as V
from tessera.operators import lifecycle as L
from tessera.sources.tables import EVIDENCE, LEDGER, MESSAGES, evidence, ledger, messages, table


def evid_admission(spark, d):
    m = messages(spark, d)
    withdrawn = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("conversation_id"))
    existing = m.where("sequence = 1").select(L.key_of(F.col("conversation_id"), F.col("sequence")).alias("evidence_id"))
    return L.admissible(m, withdrawn, existing)


def evid_ingest(spark, d):
    e = ledger(spark, d)
    return L.ingested(e.where("event_type <> 'error'"), e.where("event_type = 'error' and k < 20"), ["user_id", "k"], "event_type", "event_id")


def evid_outbox_fold(spark, d):
    e = ledger(spark, d)
    operation = F.when((F.col("event_type") == "error") & (F.col("k") % 2 == 0), "DELETE").otherwise("INGEST")
    applied = F.when(F.col("k") % 3 != 0, F.col("k") % 3 == 1)
    return L.outbox_state(e.select(F.col("user_id").alias("evidence_id"), operation.alias("operation"), applied.alias("applied"), F.when(F.col("k") % 3 == 2, F.concat(F.lit("E"), F.col("k").cast("string"))).alias("error"), F.col("event_id").alias("at")))


def lineage_redaction(spark, d):
    gone = V.closure(V.order_lineage(table(spark, d, "orders"), table(spark, d, "lineitem")), table(spark, d, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") * 4).alias("id")))
    views = {"orders": table(spark, d, "orders").select((F.col("o_orderkey") * 4 + 1).alias("id")), "parts": table(spark, d, "part").select((F.col("p_partkey") * 4 + 2).alias("id")), "customers": table(spark, d, "customer").select((F.col("c_custkey") * 4).alias("id"))}
    return L.redacted_views(gone, views)


def evid_stale_versions(spark, d):
    item = table(spark, d, "lineitem")
    return L.stale_versions(item.select(F.col("l_orderkey").alias("version"), F.col("l_partkey").alias("id")), table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("id")))


def evid_manifest_valid(spark, d):
    e = evidence(spark, d).select("id", "owner_id", F.sha2("text", 256).alias("hash"))
    return L.manifest_valid(e.select(F.concat("owner_id", F.lit("/"), (F.col("id") % 7).cast("string")).alias("name"), "id", F.when(F.col("id") % 97 == 5, "other").otherwise(F.col("hash")).alias("hash")), e)


def evid_privacy_epoch(spark, d):
    return L.privacy_epoch(ledger(spark, d), "user_id", F.when(F.col("event_type") == "error", "EVIDENCE_DELETED").otherwise(F.col("event_type")))


def evid_live_runs(spark, d):
    item = table(spark, d, "lineitem")
    scope = F.when(F.col("l_linenumber") % 2 == 0, "room").otherwise("turn")
    published = item.select(F.col("l_orderkey").alias("run"), scope.alias("scope"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("id"))
    return L.live_runs(published, {"room": table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id")), "turn": table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))})


def evid_missing(spark, d):
    docs, labels = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return L.missing(docs, labels.where("toxic = 0").select("id"), labels.where("toxic = 1").select("id"))


def evid_validity(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    reason = L.deny_reason(F.col("c_acctbal") >= 0, F.col("o_orderstatus") != "P", F.col("c_mktsegment") != "BUILDING", F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") < 300000)
    return o.join(c, "o_custkey", "left").select("o_orderkey", reason.alias("deny_reason"))


def evid_unknown_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(L.unknown_fields(F.col("props"), ["kind", "at"]), ",").alias("unknown"))


def sched_reply_queue(spark, d):
    m = messages(spark, d)
    return L.reply_queue(m.where("reply_state = 'WAITING'").select("conversation_id", "sequence"), m.where("conversation_id = 0").select("conversation_id").distinct(), "conversation_id", ["sequence", "conversation_id"])


SQL = {
    "evid_admission": f"""WITH {MESSAGES} SELECT sha256(conversation_id || ':' || sequence) AS evidence_id, conversation_id, sequence, 'PENDING' AS status, 'INGEST' AS operation FROM messages
      WHERE speaker = 'USER' AND NOT deleted AND sequence <> 1 AND conversation_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "evid_ingest": f"""WITH {LEDGER}, r AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id, k ORDER BY event_id) AS ft, min(event_id) OVER (PARTITION BY user_id, k) AS fe FROM ledger WHERE event_type <> 'error'),
      g AS (SELECT DISTINCT user_id, k FROM ledger WHERE event_type = 'error' AND k < 20)
      SELECT r.user_id, r.k, event_id, CASE WHEN g.k IS NOT NULL THEN 'REFUSED' WHEN event_id = fe THEN 'ACCEPTED' WHEN event_type = ft THEN 'DUPLICATE' ELSE 'CONFLICT' END AS outcome FROM r LEFT JOIN g ON g.user_id = r.user_id AND g.k = r.k""",
    "evid_outbox_fold": f"""WITH {LEDGER}, a AS (SELECT user_id AS evidence_id, CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'DELETE' ELSE 'INGEST' END AS operation, CASE WHEN k % 3 <> 0 THEN k % 3 = 1 END AS applied, CASE WHEN k % 3 = 2 THEN 'E' || k END AS error, event_id FROM ledger),
      o AS (SELECT evidence_id, operation, count(applied) AS attempts, bool_or(applied) AS applied FROM a GROUP BY evidence_id, operation),
      l AS (SELECT evidence_id, operation, error FROM a QUALIFY row_number() OVER (PARTITION BY evidence_id, operation ORDER BY event_id DESC) = 1),
      c AS (SELECT o.*, l.error FROM o JOIN l USING (evidence_id, operation) QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY operation <> 'DELETE') = 1)
      SELECT evidence_id, operation, attempts, CASE WHEN applied THEN 'APPLIED' WHEN attempts > 0 THEN 'FAILED' ELSE 'PENDING' END AS state, CASE WHEN NOT coalesce(applied, false) AND attempts > 0 THEN error END AS error_class FROM c""",
    "lineage_redaction": """WITH RECURSIVE e AS (SELECT o_custkey * 4 AS u, o_orderkey * 4 + 1 AS v FROM orders UNION SELECT l_orderkey * 4 + 1, l_partkey * 4 + 2 FROM lineitem),
      r(id) AS (SELECT c_custkey * 4 FROM customer WHERE c_custkey % 100 = 0 UNION SELECT v FROM r JOIN e ON e.u = r.id),
      v AS (SELECT 'orders' AS view, o_orderkey * 4 + 1 AS id FROM orders UNION ALL SELECT 'parts', p_partkey * 4 + 2 FROM part UNION ALL SELECT 'customers', c_custkey * 4 FROM customer)
      SELECT view, v.id, r.id IS NOT NULL AS redacted FROM v LEFT JOIN r ON r.id = v.id""",
    "evid_stale_versions": "SELECT l_orderkey AS version, count(p_partkey) AS n_lost, count(p_partkey) > 0 AS invalid FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size = 1 GROUP BY l_orderkey",
    "evid_manifest_valid": f"WITH {EVIDENCE} SELECT owner_id || '/' || (id % 7) AS name, bool_and(id % 97 <> 5) AS valid, count(*) AS n_entries FROM evidence GROUP BY owner_id || '/' || (id % 7)",
    "evid_privacy_epoch": "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS epoch FROM events GROUP BY user_id",
    "evid_live_runs": """SELECT DISTINCT l_orderkey AS run FROM lineitem WHERE l_linenumber % 2 = 0 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) OR l_linenumber % 2 = 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""",
    "evid_missing": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IN (0, 1))",
    "evid_validity": """SELECT o_orderkey, CASE WHEN coalesce(c_acctbal < 0, true) THEN 'ROOM' WHEN o_orderstatus = 'P' THEN 'RESEARCH' WHEN coalesce(c_mktsegment = 'BUILDING', true) THEN 'MODEL' WHEN o_orderkey % 5 = 0 THEN 'EPOCH'
      WHEN o_orderpriority = '1-URGENT' THEN 'SKILL' WHEN o_totalprice >= 300000 THEN 'SOURCES' END AS deny_reason FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "evid_unknown_fields": "SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('kind', 'at'))), ',') AS unknown FROM events",
    "sched_reply_queue": f"""WITH {MESSAGES}, f AS (SELECT conversation_id, min(sequence) AS sequence FROM messages WHERE reply_state = 'WAITING' AND conversation_id <> 0 GROUP BY conversation_id),
      q AS (SELECT *, CAST(row_number() OVER (ORDER BY sequence, conversation_id) AS INT) AS position FROM f) SELECT * FROM q WHERE position <= 1""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("evid_", "lineage_", "sched_"))]
