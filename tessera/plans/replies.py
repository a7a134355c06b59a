"""Queries on replies and their limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import replies as R
from tessera.operators import voices as W
from tessera.sources.tables import LEDGER, MESSAGES, ledger, messages, table


def conv_accepted_sends(spark, d):
    """Events as messages that clients send to rooms, under keys that come again."""
    e = ledger(spark, d)
    sends = e.select(F.col("user_id").alias("conversation_id"), (F.col("event_id") % 40).alias("request_key"), F.col("event_id").alias("place"), F.when(F.col("k") % 4 != 0, F.col("event_id") % 40 % 3).otherwise(F.col("k")).alias("text"))
    rooms = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("deleted", F.col("id") % 11 == 3)
    return R.accepted(sends, rooms, ["text"]).select("conversation_id", "request_key", "place", "outcome")


def conv_reply_batches(spark, d):
    return R.reply_batches(messages(spark, d))


def conv_public_batches(spark, d):
    """A reply per order, for two messages of a conversation, and research per event, for one."""
    key, status = F.col("o_orderkey"), ("QUEUED", "GENERATING", "DELIVERING", "COMPLETED", "FAILED")
    b = table(spark, d, "orders").select(key.alias("batch_id"), (key % 100).alias("conversation_id"), F.element_at(F.array(*map(F.lit, status)), (key % 5 + 1).cast("int")).alias("status"), F.when(key % 5 == 4, "lost").alias("failure"), (key % 3).alias("published_count"))
    sources = b.select("batch_id", F.explode(F.array(F.col("conversation_id") * 1000 + F.col("batch_id") % 4, F.col("conversation_id") * 1000 + 1)).alias("message_id"))
    runs = ledger(spark, d).select(F.col("event_id").alias("run_id"), (F.col("event_id") % 100).alias("conversation_id"), F.col("event_type").alias("phase"), F.when(F.col("k") % 2 == 0, "READY").otherwise("SNIPPETS_ONLY").alias("run_status"), "k")
    return R.public_batches(b, sources, runs, runs.select("run_id", (F.col("conversation_id") * 1000 + F.col("k") % 60).alias("message_id")))


def sched_dropped_followups(spark, d):
    e = ledger(spark, d)
    batches = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), (F.col("o_custkey") % 150).alias("conversation_id"), F.when(F.col("o_orderkey") % 3 == 0, "WAITING_FOLLOWUP").otherwise("DELIVERING").alias("status"))
    presence = e.select(F.col("user_id").alias("conversation_id"), (F.col("event_type") == "view").alias("visible"), (F.col("k") % 2 == 0).alias("composing"), F.col("k").alias("expires_at"))
    return R.dropped_followups(batches, presence, F.lit(80))


def conv_still_pending(spark, d):
    e = ledger(spark, d)
    pending = e.select((F.col("event_id") % 7000).alias("request_id"), F.col("event_id").alias("place"), "event_type")
    stored = e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"))
    return R.still_pending(pending, stored, e.where("k % 10 = 0").select((F.col("event_id") % 7000).alias("request_id")))


def sched_top_ups(spark, d):
    """Customers as sessions, their orders as top-ups."""
    state = F.element_at(F.array(*map(F.lit, (*R.AT_REST, "RUNNING"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    sessions = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), state.alias("state"), F.lit(20).cast("long").alias("messages"), F.lit(30_000).cast("long").alias("tokens"), F.lit(20).cast("long").alias("web_requests"))
    key = F.col("o_orderkey")
    grants = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.when(key % 4 != 0, key % 23).alias("add_messages"), (key % 7 * 5000).alias("add_tokens"), F.when(key % 3 != 0, key % 21).otherwise(0).alias("add_web_requests"))
    return R.topped_up(sessions, grants)


def conv_topics(spark, d):
    m = table(spark, d, "conversations")
    sessions = m.groupBy(F.col("conv_id").alias("session_id")).agg(F.concat(F.lit("about "), F.count(F.lit(1)).cast("string")).alias("topic"))
    return R.topics(sessions, m.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("place"), "text")).select("session_id", F.sha2("topic", 256).alias("topic"))


def evid_audit_trail(spark, d):
    e = ledger(spark, d)
    return R.audit_trail(e.select(F.when(F.col("k") % 3 == 0, "SYSTEM").alias("actor"), F.col("event_type").alias("operation"), F.col("event_id").alias("id"), F.col("us").alias("at"), F.when(F.col("k") % 5 != 0, F.col("props")).alias("detail")))


def conv_voice_examples(spark, d):
    """Turns as topics, each with the name of a nation; nations as the examples of their region's voice."""
    scenes = ("smalltalk", "help", "joke", "challenge", "correction", "unknown", "distress")
    n = table(spark, d, "nation")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    examples = n.select(F.col("n_regionkey").cast("long").alias("voice"), F.col("n_nationkey").cast("long").alias("place"), pick(scenes, F.col("n_nationkey") % 7).alias("scene"), F.array(F.col("n_name"), F.lit("")).alias("tags"))
    names = n.select(F.col("n_nationkey").cast("long").alias("about"), F.col("n_name"))
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("topic_id"), (F.col("conv_id") % 5).alias("voice"), (F.col("conv_id") * 3 + F.col("turn")).alias("k")).withColumn("about", F.col("k") % 40)
    said = turns.join(names, "about", "left").select("topic_id", "voice", F.concat(pick(("Hello you", "HOW I wonder", "that is wrong", "so be it"), F.col("k") % 4), F.lit(" "), F.coalesce("n_name", F.lit(""))).alias("text"))
    return W.chosen_examples(examples, said)


SQL = {
    "conv_accepted_sends": f"""WITH {LEDGER}, s AS (SELECT user_id AS conversation_id, event_id % 40 AS request_key, event_id AS place, CASE WHEN k % 4 <> 0 THEN event_id % 40 % 3 ELSE k END AS text,
        user_id IN (SELECT conv_id FROM conversations) AND user_id % 11 <> 3 AS open FROM ledger), f AS (SELECT conversation_id, request_key, min(place) AS first, min_by(text, place) AS content FROM s WHERE open GROUP BY conversation_id, request_key)
      SELECT s.conversation_id, s.request_key, place, CASE WHEN NOT open THEN 'ROOM' WHEN place = first THEN 'NEW' WHEN text = content THEN 'REPEATED' ELSE 'CONFLICT' END AS outcome FROM s LEFT JOIN f ON f.conversation_id = s.conversation_id AND f.request_key = s.request_key""",
    "conv_reply_batches": f"""WITH {MESSAGES} SELECT conversation_id, sequence, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY sequence) AS INT) AS position, count(*) OVER (PARTITION BY conversation_id) AS n
      FROM messages WHERE speaker = 'USER' AND NOT deleted AND reply_state = 'WAITING'""",
    "conv_public_batches": f"""WITH {LEDGER}, b AS (SELECT o_orderkey AS k, o_orderkey % 100 AS room, ['QUEUED', 'GENERATING', 'DELIVERING', 'COMPLETED', 'FAILED'][CAST(o_orderkey % 5 AS INT) + 1] AS status FROM orders),
      s AS (SELECT k, room, unnest([room * 1000 + k % 4, room * 1000 + 1]) AS message FROM b), r AS (SELECT event_id, event_id % 100 AS room, event_type AS phase, CASE WHEN k % 2 = 0 THEN 'READY' ELSE 'SNIPPETS_ONLY' END AS run_status, event_id % 100 * 1000 + k % 60 AS message FROM ledger),
      p AS (SELECT s.k, max_by(phase, event_id) AS phase, max_by(run_status, event_id) AS run_status FROM s JOIN r ON r.message = s.message AND r.room = s.room GROUP BY s.k)
      SELECT b.k AS batch_id, room AS conversation_id, status, CASE WHEN b.k % 5 = 4 THEN 'lost' END AS failure, b.k % 3 AS published_count, b.k % 5 < 3 AS typing, CASE WHEN status = 'GENERATING' THEN phase END AS research_phase, run_status AS research_status FROM b LEFT JOIN p ON p.k = b.k""",
    "sched_dropped_followups": f"""WITH {LEDGER} SELECT o_orderkey AS batch_id, o_custkey % 150 AS conversation_id, 'COMPLETED' AS status FROM orders WHERE o_orderkey % 3 = 0
      AND o_custkey % 150 NOT IN (SELECT user_id FROM ledger WHERE event_type = 'view' AND k % 2 <> 0 AND k > 80)""",
    "conv_still_pending": f"""WITH {LEDGER} SELECT event_id % 7000 AS request_id, min(event_id) AS place, min_by(event_type, event_id) AS event_type FROM ledger
      WHERE event_id % 7000 NOT IN (SELECT event_id FROM ledger WHERE event_type = 'view') AND event_id % 7000 NOT IN (SELECT event_id % 7000 FROM ledger WHERE k % 10 = 0) GROUP BY event_id % 7000""",
    "sched_top_ups": """WITH g AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 23 ELSE 0 END AS m, o_orderkey % 7 * 5000 AS t, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 21 ELSE 0 END AS w FROM orders),
      f AS (SELECT *, m <= 20 AND t <= 30000 AND w <= 20 AND m + t + w > 0 AND c % 5 < 4 AS fine FROM g)
      SELECT c_custkey AS id, ['CREATED', 'PAUSED', 'PAUSED_LIMIT', 'INCOMPLETE', 'RUNNING'][CAST(c_custkey % 5 AS INT) + 1] AS state, 20 + CAST(coalesce(sum(m) FILTER (WHERE fine), 0) AS BIGINT) AS messages,
        30000 + CAST(coalesce(sum(t) FILTER (WHERE fine), 0) AS BIGINT) AS tokens, 20 + CAST(coalesce(sum(w) FILTER (WHERE fine), 0) AS BIGINT) AS web_requests, count(*) FILTER (WHERE NOT fine) AS n_refused FROM customer LEFT JOIN f ON c = c_custkey GROUP BY c_custkey""",
    "conv_topics": """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
      SELECT conv_id AS session_id, sha256('about ' || any_value(n) || chr(10) || string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE back <= 2)) AS topic FROM t GROUP BY conv_id""",
    "evid_audit_trail": f"WITH {LEDGER} SELECT CASE WHEN k % 3 = 0 THEN 'SYSTEM' ELSE 'HUMAN' END AS actor, event_type AS operation, event_id AS id, us AS at, sha256(CASE WHEN k % 5 <> 0 THEN replace(props, ' ', '') ELSE 'null' END) AS detail_hash FROM ledger".replace("us AS at", 'us AS "at"'),
    "conv_voice_examples": """WITH c AS (SELECT conv_id * 1000 + turn AS topic_id, conv_id % 5 AS voice, conv_id * 3 + turn AS k FROM conversations),
      t AS (SELECT topic_id, voice, lower(['Hello you', 'HOW I wonder', 'that is wrong', 'so be it'][CAST(k % 4 AS INT) + 1] || ' ' || coalesce(n_name, '')) AS text FROM c LEFT JOIN nation ON n_nationkey = k % 40),
      e AS (SELECT n_regionkey AS voice, n_nationkey AS place, ['smalltalk', 'help', 'joke', 'challenge', 'correction', 'unknown', 'distress'][CAST(n_nationkey % 7 AS INT) + 1] AS scene, lower(n_name) AS tag FROM nation),
      s AS (SELECT topic_id, t.voice, place, scene, CASE WHEN scene = 'smalltalk' AND contains(text, 'hello') OR scene = 'help' AND contains(text, 'how ') OR scene = 'correction' AND contains(text, 'wrong') THEN 10 ELSE 0 END + CASE WHEN contains(text, tag) THEN 1 ELSE 0 END AS score FROM t JOIN e ON e.voice = t.voice),
      b AS (SELECT *, max(score) OVER (PARTITION BY topic_id) AS best, row_number() OVER (PARTITION BY topic_id, scene ORDER BY place) AS i FROM s),
      g AS (SELECT *, CASE WHEN i = 1 AND scene = 'smalltalk' THEN 1 WHEN i = 1 AND scene = 'challenge' THEN 2 ELSE 0 END AS stands FROM b), h AS (SELECT *, max(stands) OVER (PARTITION BY topic_id) AS any_stands FROM g)
      SELECT topic_id, voice, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, stands, place) AS INT) AS position, CAST(place AS BIGINT) AS place, score FROM h
      WHERE score > 0 OR best = 0 AND (stands > 0 OR any_stands = 0) QUALIFY position <= 2""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("conv_", "evid_", "sched_"))]
