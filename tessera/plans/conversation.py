"""Queries over conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import udfs
from tessera.operators import conversation as C
from tessera.operators import evidence as V
from tessera.operators import folds
from tessera.sources.tables import LEDGER, MESSAGES, ledger, messages, table

U, A = C.GONE_USER, C.GONE_AGENT


def conv_latest_message(spark, d):
    return C.previews(messages(spark, d))


def conv_recent_order(spark, d):
    return C.recent(messages(spark, d), F.pmod("conversation_id", F.lit(10)) == 0)


def conv_message_view(spark, d):
    return C.view(messages(spark, d))


def conv_context_window(spark, d):
    return C.context(messages(spark, d))


def conv_incremental_feed(spark, d):
    return C.feed(messages(spark, d), 2, F.pmod("conversation_id", F.lit(3)))


def conv_reply_state(spark, d):
    return C.replied(messages(spark, d))


def conv_client_merge(spark, d):
    m = messages(spark, d).select("conversation_id", "sequence", "text")
    local = m.where("sequence % 3 <> 0").withColumn("text", F.concat(F.lit("local:"), "text"))
    return C.merged(local, m.where("sequence % 2 = 0"), ["conversation_id", "sequence"], "text")


def conv_contact_search(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'")
    return docs.where(F.contains(F.lower(F.concat_ws(" ", "source", "lang", "text")), F.lit("src1 en the "))).select("doc_id", "source")


def conv_time_headers(spark, d):
    return C.gaps(ledger(spark, d), "user_id", "us", 6 * 3600 * 1_000_000)


def conv_redacted_rooms(spark, d):
    return V.redacted_rooms(messages(spark, d))


def conv_guarded_delete(spark, d):
    live = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("conversation_id"), F.col("doc_id").alias("id"))
    return V.deletable(messages(spark, d), live)


def conv_token_estimate(spark, d):
    m = messages(spark, d)
    return m.groupBy("conversation_id").agg(F.sum(X.estimated_tokens(F.col("text"))).alias("tokens"))


def conv_summary(spark, d):
    """Rooms of ten conversations each, one after the other."""
    rooms = messages(spark, d).select(F.floor(F.col("conversation_id") / 10).alias("conversation_id"), (F.col("conversation_id") * 1000 + F.col("sequence")).alias("sequence"), "text")
    return folds.summaries(rooms)


def conv_markdown_plain(spark, d):
    return messages(spark, d).select("conversation_id", "sequence", udfs.markdown_plain("text").alias("plain"))


def conv_dialogue_batches(spark, d):
    m = messages(spark, d).where("speaker = 'AGENT'")
    envelope = F.to_json(F.struct(F.array("text").alias("messages"), F.lit(False).alias("expects_reply")))
    batch = X.dialogue_batch(m.select("conversation_id", "sequence", envelope.alias("reply")), "reply")
    return batch.select("conversation_id", "sequence", "parts", "followup", "refused")


SUMMARY = r"""WITH RECURSIVE m AS (SELECT conv_id // 10 AS conversation_id, conv_id * 1000 + turn AS sequence, text FROM conversations WHERE role <> 'system'),
      f AS (SELECT conversation_id, sequence, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence DESC) AS back, regexp_replace(regexp_extract(text, '(?s)^.*?(?:[。！？.!?]|\n\s*\n|\z)'), '\n\s*\n$', '') AS first FROM m),
      s AS (SELECT conversation_id, first, row_number() OVER (PARTITION BY conversation_id ORDER BY back) AS i FROM f WHERE back > 12 AND length(first) BETWEEN 1 AND 500),
      p(conversation_id, i, used, summary) AS (SELECT DISTINCT conversation_id, 0::BIGINT, 0::BIGINT, '' FROM s UNION ALL
        SELECT p.conversation_id, s.i, CASE WHEN used + length(first) <= 2400 THEN used + length(first) ELSE used END,
          CASE WHEN used + length(first) > 2400 THEN summary WHEN summary = '' THEN first ELSE first || chr(10) || summary END FROM p JOIN s ON s.conversation_id = p.conversation_id AND s.i = p.i + 1)
      SELECT conversation_id, max_by(summary, i) AS summary FROM p GROUP BY conversation_id HAVING max_by(summary, i) <> ''"""
SQL = {
    "conv_summary": SUMMARY,
    "conv_latest_message": f"""WITH {MESSAGES}
      SELECT conversation_id, sequence, speaker, CASE WHEN deleted AND speaker = 'USER' THEN '{U}' WHEN deleted THEN '{A}' ELSE substring(replace(text, chr(10), ' '), 1, 100) END AS preview
      FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY sequence DESC) = 1""",
    "conv_recent_order": f"""WITH {MESSAGES}
      SELECT conversation_id, max(sequence) AS updated, count(*) AS n_messages, conversation_id % 10 = 0 AS pinned FROM messages
      GROUP BY conversation_id ORDER BY pinned DESC, updated DESC, conversation_id DESC LIMIT 100""",
    "conv_message_view": f"""WITH {MESSAGES}, m AS (SELECT *, speaker = 'USER' AND NOT deleted AND reply_state IN ('WAITING', 'FAILED') AND request_domain IS NOT NULL AND remember_requested IS NOT NULL AS retry FROM messages)
      SELECT conversation_id, sequence, speaker, CASE WHEN deleted AND speaker = 'USER' THEN '{U}' WHEN deleted THEN '{A}' ELSE text END AS text,
        CASE WHEN retry THEN text END AS retry_text, CASE WHEN retry THEN remember_requested END AS retry_remember FROM m""",
    "conv_context_window": f"""WITH {MESSAGES}, m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence DESC) AS back FROM messages)
      SELECT conversation_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY sequence) FILTER (WHERE back <= 12) AS transcript, count(*) FILTER (WHERE back > 12) AS n_earlier FROM m GROUP BY conversation_id""",
    "conv_incremental_feed": f"""WITH {MESSAGES}, r AS (SELECT conversation_id, count(*) FILTER (WHERE deleted) AS redactions FROM messages GROUP BY conversation_id)
      SELECT m.conversation_id, sequence, m.conversation_id % 3 < redactions AS reset FROM messages m JOIN r ON r.conversation_id = m.conversation_id WHERE m.conversation_id % 3 < redactions OR sequence > 2""",
    "conv_reply_state": f"""WITH {MESSAGES}
      SELECT conversation_id, sequence, CASE WHEN EXISTS (SELECT 1 FROM messages a WHERE a.speaker = 'AGENT' AND a.conversation_id = u.conversation_id AND (a.sequence = u.sequence + 1 OR a.sequence // 4 = u.sequence // 4)) THEN 'REPLIED'
        WHEN reply_state = 'WAITING' THEN 'FAILED' ELSE reply_state END AS state FROM messages u WHERE speaker = 'USER'""",
    "conv_client_merge": f"""WITH {MESSAGES}, l AS (SELECT conversation_id, sequence, 'local:' || text AS text FROM messages WHERE sequence % 3 <> 0), s AS (SELECT conversation_id, sequence, text FROM messages WHERE sequence % 2 = 0)
      SELECT coalesce(l.conversation_id, s.conversation_id) AS conversation_id, coalesce(l.sequence, s.sequence) AS sequence, coalesce(s.text, l.text) AS text
      FROM l FULL JOIN s ON l.conversation_id = s.conversation_id AND l.sequence = s.sequence""",
    "conv_contact_search": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(concat_ws(' ', source, lang, text)), 'src1 en the ')",
    "conv_time_headers": f"""WITH {LEDGER}
      SELECT event_id, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {6 * 3600 * 1_000_000}, true) AS header FROM ledger""",
    "conv_redacted_rooms": f"""WITH {MESSAGES}, hit AS (SELECT DISTINCT conversation_id FROM messages WHERE deleted AND speaker = 'USER')
      SELECT m.conversation_id, sequence, deleted OR (h.conversation_id IS NOT NULL AND speaker = 'AGENT') AS redacted FROM messages m LEFT JOIN hit h ON h.conversation_id = m.conversation_id""",
    "conv_guarded_delete": f"""WITH {MESSAGES}
      SELECT c.conversation_id, count(doc_id) AS n_live, count(doc_id) = 0 AS allowed FROM (SELECT DISTINCT conversation_id FROM messages) c LEFT JOIN labels ON doc_id = c.conversation_id AND quality = 1 GROUP BY c.conversation_id""",
    "conv_token_estimate": f"""WITH {MESSAGES}, w AS (SELECT conversation_id, text, length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) AS wide FROM messages)
      SELECT conversation_id, CAST(sum(CAST(floor(wide * 1.5 + (length(text) - wide) / 3.0::DOUBLE) AS BIGINT) + 104) AS BIGINT) AS tokens FROM w GROUP BY conversation_id""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith("conv_")]
