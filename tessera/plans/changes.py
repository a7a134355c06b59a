"""Queries on what changes: goals by revision, actions taken for them, corrections in all tables at once, snapshots that are used again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import changes as C
from tessera.operators import evidence as V
from tessera.operators import goals as G
from tessera.plans.evidence import tree
from tessera.sources.tables import EVIDENCE, LEDGER, evidence, ledger, messages, table


def _requests(spark, d):
    """Events as requests about the goal of their user."""
    e = ledger(spark, d)
    return e.select(F.col("user_id").alias("goal"), F.col("event_id").alias("place"), (F.col("k") % 3 + 1).alias("revision"), F.when(F.col("event_id") % 3 == 0, "revoke").otherwise("approve").alias("operation"))


def evid_goal_requests(spark, d):
    return G.judged_requests(_requests(spark, d))


def evid_growth_actions(spark, d):
    """Every seventh event of a user as an action for their goal, every fifth as a check-in on the first of those."""
    e = ledger(spark, d).select("event_id", "user_id", "k")
    actions = e.where("event_id % 7 = 2").select(F.col("event_id").alias("action"), F.col("user_id").alias("goal"), F.col("event_id").alias("place"), (F.col("k") % 4 != 0).alias("user_approved"))
    first = G.judged_actions(actions, _requests(spark, d)).where("allowed").groupBy("goal").agg(F.min("action").alias("action"))
    checkins = e.where("event_id % 5 = 3").join(first, F.col("user_id") == F.col("goal")).select("action", F.col("event_id").alias("place"), F.when(F.col("k") % 5 != 0, F.concat(F.lit("done "), F.col("k").cast("string"))).alias("outcome"))
    return G.checked_actions(actions, checkins, _requests(spark, d))


def evid_correction_changes(spark, d):
    """What people said as evidence, some of it withdrawn or corrected; events as research, orders as assessments, their lines as permits."""
    m = messages(spark, d).withColumn("id", F.col("conversation_id") * 1000 + F.col("sequence"))
    said = m.where("speaker = 'USER'").select("id", F.col("id").alias("message_id"), F.when(F.col("deleted"), "DELETED").otherwise("ACTIVE").alias("status"))
    asked = m.where("(conversation_id * 7 + sequence) % 11 = 0").select(F.col("id").alias("evidence_id"), F.col("id").alias("place"), F.when(F.col("conversation_id") % 2 == 0, F.concat(F.lit("rather: "), F.col("text"))).alias("text"), F.lit("work").alias("domain"))
    runs = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 5000).alias("scope_id"))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey") * 1000, F.col("o_custkey") * 1000 + 2).alias("evidence_ids"))
    permits = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_suppkey") * 1000).alias("evidence_ids"), F.col("l_orderkey").alias("assessment_id"))
    return C.change_set(C.withdrawn(asked, said, m), m, runs, tasks, permits)


def retr_cancelled_runs(spark, d):
    e = ledger(spark, d)
    phase = F.element_at(F.array(*map(F.lit, (*C.UNDER_WAY, "READY", "FAILED", "INVALIDATED"))), (F.col("k") % 7 + 1).cast("int"))
    runs = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("scope_id"), phase.alias("phase"), (F.col("event_id") % 3).alias("n_published"), F.when(F.col("event_id") % 4 == 0, F.col("k") % 2).alias("n_waiting"))
    return C.cancelled_runs(runs, e.where("tokens % 50 = 7").select(F.col("user_id").alias("scope_id")))


def _tracked(spark, d):
    return evidence(spark, d).where("status = 'ACTIVE'").withColumn("track", F.when(F.col("id") % 3 == 0, "PERCEIVED").otherwise("OBSERVED"))


def evid_snapshot_reuse(spark, d):
    """Versions of the evidence without the ids divisible by 50, met by all of it; those of one owner are invalid."""
    now, by = _tracked(spark, d), ["owner_id", "track"]
    old = V.fingerprint(now.where("id % 50 <> 0"), by)
    state = F.when(F.col("owner_id") == "src3", "INVALIDATED").otherwise("ACTIVE")
    return V.snapshots(now, old.select(*by, F.concat_ws("/", F.lit("v"), *by).alias("version_id"), F.col("fingerprint").alias("snapshot_hash"), state.alias("state")))


GOALS = f"""{LEDGER}, e AS (SELECT user_id AS goal, event_id AS place, k % 3 + 1 AS revision, CASE WHEN event_id % 3 = 0 THEN 'revoke' ELSE 'approve' END AS operation, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ledger),
      f(goal, i, place, revision, operation, state, now, outcome) AS (SELECT DISTINCT goal, 0::BIGINT, NULL::BIGINT, NULL::INT, '', 'PROPOSED', 1::BIGINT, '' FROM e UNION ALL
        SELECT e.goal, e.i, e.place, e.revision, e.operation, CASE WHEN x.fits AND state <> 'REVOKED' AND NOT x.same THEN x.target ELSE state END, CASE WHEN x.fits AND state <> 'REVOKED' AND NOT x.same THEN now + 1 ELSE now END,
          CASE WHEN x.same AND e.revision IN (now, now - 1) THEN 'REPEATED' WHEN NOT x.fits THEN 'CONFLICT' WHEN state = 'REVOKED' THEN 'REVOKED' ELSE 'APPLIED' END
        FROM f JOIN e ON e.goal = f.goal AND e.i = f.i + 1, LATERAL (SELECT e.revision = now AS fits, CASE e.operation WHEN 'approve' THEN 'APPROVED' ELSE 'REVOKED' END AS target, state = CASE e.operation WHEN 'approve' THEN 'APPROVED' ELSE 'REVOKED' END AS same) x)"""
SQL = {
    "evid_goal_requests": f"WITH RECURSIVE {GOALS} SELECT goal, place, revision, operation, outcome, now AS revision_after FROM f WHERE i > 0",
    "evid_growth_actions": f"""WITH RECURSIVE {GOALS}, p AS (SELECT goal, min(place) FILTER (WHERE outcome = 'APPLIED' AND operation = 'approve') AS a, min(place) FILTER (WHERE outcome = 'APPLIED' AND operation = 'revoke') AS z FROM f GROUP BY goal),
      g AS (SELECT event_id AS action, user_id AS goal, z FROM ledger JOIN p ON goal = user_id WHERE event_id % 7 = 2 AND k % 4 <> 0 AND event_id > a AND (z IS NULL OR event_id <= z)),
      c AS (SELECT action, event_id AS place, CASE WHEN k % 5 <> 0 THEN 'done ' || k END AS outcome, z FROM ledger JOIN (SELECT goal, min(action) AS action, min(z) AS z FROM g GROUP BY goal) ON goal = user_id WHERE event_id % 5 = 3 AND event_id > action AND (z IS NULL OR event_id < z)),
      t AS (SELECT action, min(place) AS back FROM c WHERE outcome IS NULL GROUP BY action), r AS (SELECT action, max_by(outcome, place) AS outcome FROM c WHERE action NOT IN (SELECT action FROM t) GROUP BY action)
      SELECT g.action, goal, CASE WHEN back IS NOT NULL OR z IS NOT NULL THEN 'REVOKED' WHEN outcome IS NOT NULL THEN 'SELF_REPORTED' ELSE 'APPROVED' END AS state, outcome FROM g LEFT JOIN t ON t.action = g.action LEFT JOIN r ON r.action = g.action""",
    "evid_correction_changes": """WITH m AS (SELECT conv_id AS room, turn AS sequence, role, text, conv_id * 1000 + turn AS id, (conv_id * 31 + turn * 7) % 13 = 0 AS deleted FROM conversations WHERE role <> 'system'),
      w AS (SELECT id, room, CASE WHEN room % 2 = 0 THEN 'rather: ' || text END AS text FROM m WHERE role = 'user' AND NOT deleted AND (room * 7 + sequence) % 11 = 0), rooms AS (SELECT DISTINCT room FROM w),
      n AS (SELECT w.id, w.room, text, coalesce(last, 0) + row_number() OVER (PARTITION BY w.room ORDER BY w.id) AS sequence FROM w JOIN (SELECT room, max(sequence) AS last FROM m GROUP BY room) l ON l.room = w.room WHERE text IS NOT NULL),
      t AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey * 1000 IN (SELECT id FROM w) OR o_custkey * 1000 + 2 IN (SELECT id FROM w))
      SELECT 'messages' AS view, CAST(id AS VARCHAR) AS id, 'BLANK' AS change, '[已删除]' AS detail FROM w
      UNION ALL SELECT 'messages', CAST(id AS VARCHAR), 'BLANK', '[关联来源已删除]' FROM m WHERE role <> 'user' AND room IN (SELECT room FROM rooms)
      UNION ALL SELECT 'messages', 'correction:' || id, 'ADD', room || ':' || sequence || ':' || sha256(text) FROM n
      UNION ALL SELECT 'evidence', CAST(id AS VARCHAR), 'DELETE_PENDING', NULL FROM w UNION ALL SELECT 'evidence', 'correction:' || id, 'USER_CORRECTION', CAST(id AS VARCHAR) FROM n
      UNION ALL SELECT 'outbox', CAST(id AS VARCHAR), 'DELETE', NULL FROM w UNION ALL SELECT 'research', CAST(event_id AS VARCHAR), 'INVALIDATED', NULL FROM events WHERE event_id % 5000 IN (SELECT room FROM rooms)
      UNION ALL SELECT 'assessments', CAST(id AS VARCHAR), 'INVALIDATED', NULL FROM t
      UNION ALL SELECT DISTINCT 'grants', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 'INVALIDATED', NULL FROM lineitem WHERE l_suppkey * 1000 IN (SELECT id FROM w) OR l_orderkey IN (SELECT id FROM t)""",
    "retr_cancelled_runs": f"""WITH {LEDGER} SELECT event_id AS id, 'CANCELLED' AS phase FROM ledger WHERE user_id IN (SELECT user_id FROM ledger WHERE tokens % 50 = 7)
      AND (k % 7 < 4 OR event_id % 3 = 0 OR (event_id % 4 = 0 AND k % 2 > 0))""",
    "evid_snapshot_reuse": f"""WITH {EVIDENCE}, n AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'PERCEIVED' ELSE 'OBSERVED' END AS track, id || ':' || sha256(text) AS line FROM evidence WHERE status = 'ACTIVE'), o AS (SELECT * FROM n WHERE id % 50 <> 0),
      {tree('n', ['owner_id', 'track'])}, {tree('o', ['owner_id', 'track'])}
      SELECT n.owner_id, n.track, n.line AS fingerprint, CASE WHEN o.line IS NULL THEN 'version_' || n.line ELSE 'v/' || n.owner_id || '/' || n.track END AS version_id, o.line IS NOT NULL AS reused
      FROM n_tree n LEFT JOIN o_tree o ON o.owner_id = n.owner_id AND o.track = n.track AND o.line = n.line AND o.owner_id <> 'src3'""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("evid_", "retr_"))]
