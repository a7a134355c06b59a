"""Queries over evidence and its lineage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import evidence as V
from tessera.sources.tables import EVIDENCE, LEDGER, REAL_ORIGINS, evidence, ledger, table

#: Phrase lists for the driver's invented languages, in the place of the Chinese ones.
PHRASES = (("ASPIRATION", ("scum", "keit ", "idiot")), ("NEEDS_REVIEW", ("tion to", "quele")), ("SELF_REPORT", ("the ", "der ")))
REAL = ", ".join(f"'{x}'" for x in REAL_ORIGINS)


def evid_active_by_domain(spark, d):
    return V.active_by_domain(evidence(spark, d))


def evid_claim_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.claim_kind(F.col("text"), PHRASES).alias("claim_kind"))


def evid_mirror_tracks(spark, d):
    return V.tracks(evidence(spark, d), X.claim_kind(F.col("text"), PHRASES))


def evid_access_matrix(spark, d):
    e = evidence(spark, d)
    actor = F.when(F.col("id") % 3 == 0, "HUMAN").when(F.col("id") % 3 == 1, "PERSONA").otherwise("SYSTEM")
    purpose = F.when(F.col("id") % 4 == 0, "ADMIT").when(F.col("id") % 4 == 1, "MIRROR").when(F.col("id") % 4 == 2, "SIMULATION").otherwise("TRAINING")
    return e.select("id", V.refusal(actor, F.col("owner_id"), F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("owner_id")), F.col("origin"), purpose, F.col("consent_scope").isNotNull()).alias("deny_reason"))


def evid_outbox_order(spark, d):
    return V.outbox_order(ledger(spark, d).withColumn("operation", F.when(F.col("event_type") == "error", "DELETE").otherwise("INGEST")))


def evid_idempotency_conflicts(spark, d):
    return V.conflicts(ledger(spark, d), ["user_id", "event_type"], F.sha2("props", 256), "event_id")


def evid_snapshot_fingerprint(spark, d):
    return V.fingerprint(evidence(spark, d))


def evid_valid_sets(spark, d):
    sets = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("item_id") % 3), lambda k: F.col("item_id") * 10 + 1 + k)).alias("ids"))
    return V.valid_sets(sets, evidence(spark, d), "item_id", "ids")


def lineage_closure(spark, d):
    edges = V.order_lineage(table(spark, d, "orders"), table(spark, d, "lineitem"))
    return V.closure(edges, table(spark, d, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") * 4).alias("id")))


def tree(rows: str, by: list[str], id_col: str = "id") -> str:
    """SQL of the tree of hashes over `rows` (by, id, line): `<rows>_tree` has by, line, n."""
    keys, levels = ", ".join(by), [f"{rows}_0 AS (SELECT DISTINCT {', '.join(by)}, {id_col} AS slot, line, 1 AS n FROM {rows})"]
    for k in range(3):
        total = "sum(n)" if k else "max(n)"
        levels.append(f"{rows}_{k + 1} AS (SELECT {keys}, slot // 4096 AS slot, sha256(string_agg(line, chr(10) ORDER BY slot, line)) AS line, CAST({total} AS BIGINT) AS n FROM {rows}_{k} GROUP BY {keys}, slot // 4096)")
    return ", ".join([*levels, f"{rows}_tree AS (SELECT * FROM {rows}_3)"])


SQL = {
    "evid_active_by_domain": f"WITH {EVIDENCE} SELECT domain, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM evidence WHERE status = 'ACTIVE' GROUP BY domain",
    "evid_claim_classes": """SELECT doc_id, CASE WHEN contains(text, 'scum') OR contains(text, 'keit ') OR contains(text, 'idiot') THEN 'ASPIRATION'
      WHEN contains(text, 'tion to') OR contains(text, 'quele') THEN 'NEEDS_REVIEW' WHEN contains(text, 'the ') OR contains(text, 'der ') THEN 'SELF_REPORT' ELSE 'OBSERVATION' END AS claim_kind FROM documents""",
    "evid_mirror_tracks": f"""WITH {EVIDENCE}, r AS (SELECT *, CASE WHEN contains(text, 'scum') OR contains(text, 'keit ') OR contains(text, 'idiot') THEN 'ASPIRATION'
        WHEN contains(text, 'tion to') OR contains(text, 'quele') THEN 'NEEDS_REVIEW' WHEN contains(text, 'the ') OR contains(text, 'der ') THEN 'PERCEIVED' ELSE 'OBSERVED' END AS track FROM evidence WHERE status = 'ACTIVE'),
      p AS (SELECT *, row_number() OVER (PARTITION BY owner_id, track ORDER BY id) AS place FROM r WHERE track IN ('PERCEIVED', 'OBSERVED'))
      SELECT owner_id, track, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE place <= 20) AS first_ids FROM p GROUP BY owner_id, track""",
    "evid_access_matrix": f"""WITH {EVIDENCE}, e AS (SELECT id, origin, consent_scope, ['HUMAN', 'PERSONA', 'SYSTEM'][CAST(id % 3 AS INT) + 1] AS actor, ['ADMIT', 'MIRROR', 'SIMULATION', 'TRAINING'][CAST(id % 4 AS INT) + 1] AS purpose FROM evidence)
      SELECT id, CASE WHEN id % 11 = 0 OR actor = 'SYSTEM' THEN 'NOT_OWN' WHEN origin NOT IN ({REAL}) THEN 'ORIGIN' WHEN purpose = 'TRAINING' THEN 'PURPOSE'
        WHEN purpose = 'ADMIT' AND actor <> 'HUMAN' THEN 'NOT_HUMAN' WHEN purpose = 'SIMULATION' AND consent_scope IS NULL THEN 'NOT_GRANTED' END AS deny_reason FROM e""",
    "evid_outbox_order": f"""WITH {LEDGER}, o AS (SELECT *, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INGEST' END AS operation FROM ledger)
      SELECT user_id, event_id, operation, CAST(row_number() OVER (PARTITION BY user_id ORDER BY operation <> 'DELETE', event_id) AS INT) AS position FROM o""",
    "evid_idempotency_conflicts": """SELECT user_id, event_type, count(*) AS n, count(DISTINCT props) AS n_fingerprints, min_by(sha256(props), event_id) AS first_fingerprint, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY user_id, event_type""",
    "evid_snapshot_fingerprint": f"WITH {EVIDENCE}, e AS (SELECT *, id || ':' || sha256(text) AS line FROM evidence), {tree('e', ['owner_id'])} SELECT owner_id, line AS fingerprint, n AS n_leaves FROM e_tree",
    "evid_valid_sets": f"""WITH {EVIDENCE}, s AS (SELECT item_id, unnest(CASE WHEN item_id % 9 = 0 THEN [NULL] ELSE list_transform(range(item_id % 3 + 1), lambda k: item_id * 10 + 1 + k) END) AS id FROM benchmark)
      SELECT item_id, bool_and(coalesce(status = 'ACTIVE' AND origin IN ({REAL}) AND consent_scope IS NOT NULL, false)) AS valid FROM s LEFT JOIN evidence e ON e.id = s.id GROUP BY item_id""",
    "lineage_closure": """WITH RECURSIVE e AS (SELECT o_custkey * 4 AS u, o_orderkey * 4 + 1 AS v FROM orders UNION SELECT l_orderkey * 4 + 1, l_partkey * 4 + 2 FROM lineitem),
      r(id) AS (SELECT c_custkey * 4 FROM customer WHERE c_custkey % 100 = 0 UNION SELECT v FROM r JOIN e ON e.u = r.id) SELECT id FROM r""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("evid_", "lineage_"))]
