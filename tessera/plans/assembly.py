"""Queries that assemble views and drafts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import assembly as A
from tessera.operators import evaluation as E
from tessera.sources.tables import EVIDENCE, LEDGER, evidence, ledger, table

GRAMMAR = [(r"src[0-4]", "CHAT"), (r"src\d+", "IMPORT")]


def conv_sequence_numbers(spark, d):
    c = table(spark, d, "conversations")
    prior = c.where("turn < 2 and conv_id % 3 <> 0").select("conv_id", F.col("turn").alias("sequence"))
    return A.numbered(c.where("turn >= 2").select("conv_id", "turn"), prior, "conv_id", "turn")


def evid_guarded_lookup(spark, d):
    asked = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("id"))
    return A.guarded(evidence(spark, d), asked, (F.col("status") == "ACTIVE") & (F.col("owner_id") == "src0")).select("id", "domain", "origin")


def evid_merged_drafts(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_orderkey") % 5).alias("version"), "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "N").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    return A.merged_draft(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def evid_references(spark, d):
    return A.references(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey")), "l_orderkey", "l_partkey")


def retr_shown_evidence(spark, d):
    e = evidence(spark, d)
    ranked = e.select("owner_id", "id", F.sha2(F.col("id").cast("string"), 256).alias("rank"))
    return A.shown_evidence(ranked, e.where("status = 'ACTIVE' and consent_scope is not null"), "owner_id", "rank")


def lineage_dependents(spark, d):
    i = table(spark, d, "lineitem")
    links = {"part": i.select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("id")), "supplier": i.select(F.col("l_orderkey").alias("session"), F.col("l_suppkey").alias("id"))}
    changed = {"part": table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("id")), "supplier": table(spark, d, "supplier").where("s_acctbal < -900").select(F.col("s_suppkey").alias("id"))}
    return A.dependents(links, changed)


def eval_progress(spark, d):
    return A.progress(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F", 3)


def evid_repeated(spark, d):
    return A.repeated(table(spark, d, "lineitem"), "l_partkey", ["l_orderkey", "l_suppkey"])


def evid_newest_valid(spark, d):
    return A.newest(ledger(spark, d), "user_id", F.col("k") % 4 == 1, ["us", "event_id"], "event_id")


def eval_arm_rotation(spark, d):
    return A.rotated(table(spark, d, "benchmark").select(F.col("item_id").alias("case_id")), E.ARMS)


def eval_batches(spark, d):
    return A.batches(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)


def _results(spark, d):
    """Pages as the results of a run for each site; what came by plain http was not read."""
    pages = table(spark, d, "pages")
    return pages.select(X.host(F.col("url")).alias("run"), "page_id", "url", F.when(F.col("url").startswith("https:"), F.col("html")).alias("body"))


def retr_candidates(spark, d):
    """Beside those that each site's run already knows: pages whose address has a query."""
    found = _results(spark, d)
    return A.candidates(found, found.where("contains(url, '?') and page_id % 2 = 0"), "run", "page_id")


def retr_run_status(spark, d):
    """Sites whose addresses all have a query have found nothing else."""
    found = _results(spark, d)
    kind = F.when(F.col("body").isNotNull(), "PAGE_CONTENT").otherwise("SEARCH_SNIPPET")
    return A.run_status(found, found.where("not contains(url, '?')").withColumn("kind", kind), "run")


def eval_answer_faults(spark, d):
    choice = F.substring("text", 1, 1)
    docs = table(spark, d, "documents")
    stored = F.when(F.col("doc_id") % 3 == 0, "A")
    return docs.select("doc_id", A.answer_faults(F.when(F.col("doc_id") % 5 < 3, F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("doc_id") % 3 + 1).cast("int"))).when(F.col("doc_id") % 5 == 3, "B").otherwise(choice), F.col("text"), stored).alias("fault"))


def sched_action_limits(spark, d):
    e = ledger(spark, d)
    return A.over_limit(e.select(F.concat_ws(":", "user_id", "k").alias("run"), "event_type", "us"), "run", F.when(F.col("event_type") == "view", "search").otherwise("read"), F.floor(F.col("us") / 86_400_000_000))


def evid_source_types(spark, d):
    return table(spark, d, "documents").select("doc_id", A.source_type(F.col("source"), GRAMMAR).alias("source_type"))


def lineage_scrubbed(spark, d):
    return A.scrubbed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", ["o_orderstatus", "o_totalprice"])


def text_plain_forms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.kept_words(F.col("text")), 256).alias("kept"), X.byte_estimate(F.col("text")).alias("bytes"))


SQL = {
    "conv_sequence_numbers": """WITH p AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE turn < 2 AND conv_id % 3 <> 0 GROUP BY conv_id)
      SELECT c.conv_id, turn, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS BIGINT) AS sequence FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id WHERE turn >= 2""",
    "evid_guarded_lookup": f"WITH {EVIDENCE} SELECT id, domain, origin FROM evidence WHERE status = 'ACTIVE' AND owner_id = 'src0' AND id IN (SELECT item_id * 3 FROM benchmark)",
    "evid_merged_drafts": """SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CAST(CASE WHEN n.o_orderkey IS NULL THEN version ELSE coalesce(version, 0) + 1 END AS BIGINT) AS version, coalesce(n.s, o.o_orderstatus) AS o_orderstatus, o.o_orderpriority, sha256(coalesce(n.s, o.o_orderstatus, '') || chr(10) || coalesce(o.o_orderpriority, '')) AS content_hash
      FROM (SELECT *, o_orderkey % 5 AS version FROM orders WHERE o_orderkey % 3 <> 0) o FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'N' END AS s FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) n ON n.o_orderkey = o.o_orderkey""",
    "evid_references": "SELECT l_orderkey, count(*) AS n_sources, count(*) - count(p_partkey) AS n_invented, count(*) = count(p_partkey) AS stands FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 GROUP BY l_orderkey",
    "retr_shown_evidence": f"""WITH {EVIDENCE} SELECT owner_id, id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY sha256(CAST(id AS VARCHAR)), id) AS INT) AS place, substring(text, 1, 1000) AS shown FROM evidence
      WHERE status = 'ACTIVE' AND consent_scope IS NOT NULL QUALIFY place <= 3""",
    "lineage_dependents": "SELECT DISTINCT l_orderkey AS session FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < -900)",
    "eval_progress": "SELECT l_orderkey, least(count(*) FILTER (WHERE l_linestatus = 'F'), 3) AS done, round(least(count(*) FILTER (WHERE l_linestatus = 'F'), 3) * 100.0::DOUBLE / 3, 1) AS percent FROM lineitem GROUP BY l_orderkey",
    "evid_repeated": "SELECT l_partkey, count(DISTINCT (l_orderkey, l_suppkey)) AS n_places, CASE WHEN count(DISTINCT (l_orderkey, l_suppkey)) >= 2 THEN 'REPEATED' ELSE 'SINGLE' END AS kind FROM lineitem GROUP BY l_partkey",
    "evid_newest_valid": f"WITH {LEDGER} SELECT user_id, max_by(event_id, (us, event_id)) FILTER (WHERE k % 4 = 1) AS event_id, count(*) FILTER (WHERE k % 4 = 1) AS n_valid FROM ledger GROUP BY user_id",
    "eval_arm_rotation": "SELECT item_id AS case_id, arm, CAST(row_number() OVER (PARTITION BY item_id ORDER BY sha256(item_id || ':' || arm)) AS INT) AS position FROM benchmark, (VALUES ('B0'), ('B1'), ('B2'), ('D')) x(arm)",
    "eval_batches": "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS batch FROM orders",
    "retr_candidates": rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS run, regexp_replace(url, '#.*$', '') AS url, url LIKE 'https:%' AND length(trim(html)) > 0 AS read FROM pages),
      k AS (SELECT DISTINCT run, url FROM p WHERE url LIKE '%?%' AND page_id % 2 = 0), c AS (SELECT run, url, min(page_id) AS page_id, min_by(read, page_id) AS read FROM p WHERE (run, url) NOT IN (SELECT (run, url) FROM k) GROUP BY run, url),
      r AS (SELECT *, CASE WHEN regexp_matches(run, '\.(gov\.cn|edu\.cn|gov|edu)$') THEN 'OFFICIAL_DOMAIN' ELSE 'PUBLIC_SOURCE' END AS authority FROM c),
      o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY authority <> 'OFFICIAL_DOMAIN', page_id) AS position FROM r)
      SELECT o.run, CAST(position AS INT) AS position, url, authority, CASE WHEN read THEN 'PAGE_CONTENT' ELSE 'SEARCH_SNIPPET' END AS kind FROM o LEFT JOIN (SELECT run, count(*) AS n FROM k GROUP BY run) t ON t.run = o.run WHERE position <= 5 - coalesce(n, 0)""",
    "retr_run_status": """WITH p AS (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS run, url LIKE '%?%' AS known, url LIKE 'https:%' AS page FROM pages), f AS (SELECT run, bool_or(page) AS pages FROM p WHERE NOT known GROUP BY run)
      SELECT r.run, CASE WHEN pages THEN 'READY' WHEN NOT pages THEN 'SNIPPETS_ONLY' ELSE 'NO_RESULTS' END AS status FROM (SELECT DISTINCT run FROM p) r LEFT JOIN f ON f.run = r.run""",
    "eval_answer_faults": """WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 5 < 3 THEN ['A', 'B', 'C'][CAST(doc_id % 3 AS INT) + 1] WHEN doc_id % 5 = 3 THEN 'B' ELSE substring(text, 1, 1) END AS choice FROM documents)
      SELECT doc_id, CASE WHEN NOT coalesce(choice IN ('A', 'B', 'C'), false) THEN 'CHOICE' WHEN NOT coalesce(length(trim(text)) BETWEEN 8 AND 4000, false) THEN 'REASON' WHEN doc_id % 3 = 0 AND choice <> 'A' THEN 'CHANGED' END AS fault FROM a""",
    "sched_action_limits": f"""WITH {LEDGER}, r AS (SELECT user_id || ':' || k AS run, count(DISTINCT us // 86400000000) AS rounds, count(*) FILTER (WHERE event_type = 'view') AS searches, count(*) AS actions FROM ledger GROUP BY user_id || ':' || k)
      SELECT *, CASE WHEN rounds > 2 THEN 'ROUNDS' WHEN searches > 3 THEN 'SEARCHES' WHEN actions > 4 THEN 'ACTIONS' END AS passed_limit FROM r""",
    "evid_source_types": "SELECT doc_id, CASE WHEN regexp_full_match(source, 'src[0-4]') THEN 'CHAT' WHEN regexp_full_match(source, 'src[0-9]+') THEN 'IMPORT' END AS source_type FROM documents",
    "lineage_scrubbed": """WITH g AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)
      SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN o_orderstatus END AS o_orderstatus, CASE WHEN l_orderkey IS NULL THEN o_totalprice END AS o_totalprice FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
    "text_plain_forms": r"SELECT doc_id, sha256(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) AS kept, octet_length(encode(text)) + 256 AS bytes FROM documents",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("conv_", "evid_", "retr_", "lineage_", "eval_", "sched_", "text_"))]
