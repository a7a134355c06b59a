"""Replies from the message that is accepted to the parts that are shown: what is sent once, which messages a reply answers, what its room may see of it, and its limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States in which a reply is being written; what one top-up may add at most; states in which a session may be topped up. Fixed values.
TYPING = ("QUEUED", "GENERATING", "DELIVERING")
MOST_ADDED = {"messages": 20, "tokens": 30_000, "web_requests": 20}
AT_REST = ("CREATED", "PAUSED", "PAUSED_LIMIT", "INCOMPLETE")
#: Turns that go with a topic. Fixed value.
LAST_TURNS = 2


def accepted(sends: DataFrame, rooms: DataFrame, content: Sequence[str], room: str = "conversation_id", key: str = "request_key", place: str = "place") -> DataFrame:
    """sends with `outcome`: ROOM (deleted or unknown), NEW (the first of its key), REPEATED (the same content under a key that is known) or CONFLICT (other content).

    rooms: id, deleted. A key is a room's own. Only each key's first content is kept to compare with, found by a minimum, so a key may be sent any number of times.
    """
    open_ = rooms.where(~F.col("deleted")).select(F.col("id").alias(room), F.lit(True).alias("open"))
    live = sends.join(open_, room, "left").withColumn("content", F.struct(*content))
    first = live.where("open").groupBy(room, key).agg(F.min_by(F.struct("content", place), place).alias("first"))
    both = live.join(first, [room, key], "left")
    outcome = F.when(F.col("open").isNull(), "ROOM").when(F.col(place) == F.col(f"first.{place}"), "NEW").when(F.col("content").eqNullSafe(F.col("first.content")), "REPEATED").otherwise("CONFLICT")
    return both.select(*sends.columns, outcome.alias("outcome"))


def reply_batches(messages: DataFrame) -> DataFrame:
    """(conversation_id, sequence, position, n) of the messages that a room's next reply answers together: those of people that wait and are not deleted, in order.

    messages: conversation_id, sequence, speaker, deleted, reply_state. A row per message, not a list per room.
    """
    waiting = messages.where("speaker = 'USER' and not deleted and reply_state = 'WAITING'").select("conversation_id", "sequence")
    room = Window.partitionBy("conversation_id")
    return waiting.withColumn("position", F.row_number().over(room.orderBy("sequence"))).withColumn("n", F.count(F.lit(1)).over(room))


def public_batches(batches: DataFrame, sources: DataFrame, progress: DataFrame, progress_sources: DataFrame, fields: Sequence[str] = ("batch_id", "conversation_id", "status", "failure", "published_count")) -> DataFrame:
    """What a room may see of its replies: the allowed fields, whether one is being written, and the progress of research, if that is for one of the reply's own messages.

    batches: fields; sources: batch_id, message_id; progress: run_id, conversation_id, phase, run_status; progress_sources: run_id, message_id. A phase shows only while the reply is being generated.
    Only the last run of each message meets the replies, so a message of many replies and many runs makes no pairs of them.
    """
    of_message = progress.join(progress_sources.select("run_id", "message_id"), "run_id").groupBy("message_id", "conversation_id").agg(F.max_by(F.struct("run_id", "phase", "run_status"), "run_id").alias("run"))
    own = sources.select("batch_id", "message_id").join(batches.select("batch_id", "conversation_id"), "batch_id")
    last = own.join(of_message, ["message_id", "conversation_id"]).groupBy("batch_id", "conversation_id").agg(F.max_by("run", "run.run_id").alias("run"))
    both = batches.select(*fields).join(last, ["batch_id", "conversation_id"], "left")
    phase = F.when(F.col("status") == "GENERATING", F.col("run.phase"))
    return both.select(*fields, F.coalesce(F.col("status").isin(*TYPING), F.lit(False)).alias("typing"), phase.alias("research_phase"), F.col("run.run_status").alias("research_status"))


def dropped_followups(batches: DataFrame, presence: DataFrame, now) -> DataFrame:
    """batches (batch_id, conversation_id, status, next_at) that wait to follow up in a room where nobody is present any more: they are COMPLETED without it.

    presence: conversation_id, visible, composing, expires_at. Present is who sees the room, is not writing, and has not expired.
    """
    here = presence.where(F.col("visible") & ~F.col("composing") & (F.col("expires_at") > now)).select("conversation_id")
    return batches.where("status = 'WAITING_FOLLOWUP'").join(here, "conversation_id", "left_anti").select("batch_id", "conversation_id", F.lit("COMPLETED").alias("status"))


def still_pending(pending: DataFrame, stored: DataFrame, cancelled: DataFrame, key: str = "request_id") -> DataFrame:
    """What a client still has to send: what was neither stored, under the client's own id, nor taken back; each id once, the first."""
    left = pending.join(stored.select(key), key, "left_anti").join(cancelled.select(key), key, "left_anti")
    return left.groupBy(key).agg(F.min_by(F.struct(*[c for c in left.columns if c != key]), "place").alias("x")).select(key, "x.*")


def topped_up(sessions: DataFrame, grants: DataFrame) -> DataFrame:
    """sessions (id, state, messages, tokens, web_requests) with their limits after all top-ups that count, and how many were refused. The state stays: a top-up resumes nothing.

    grants: session_id, and what each adds (null: 0). One counts if its session is at rest, each part is between 0 and the most that may be added, and they are not all 0.
    """
    parts = {n: F.coalesce(f"add_{n}", F.lit(0)) for n in MOST_ADDED}
    fine = sum(parts.values(), F.lit(0)) > 0
    for n, most in MOST_ADDED.items():
        fine &= parts[n].between(0, most)
    able = grants.join(sessions.select(F.col("id").alias("session_id"), F.col("state").isin(*AT_REST).alias("rests")), "session_id").withColumn("counts", fine & F.col("rests"))
    added = able.groupBy(F.col("session_id").alias("id")).agg(*[F.sum(F.when(F.col("counts"), c).otherwise(0)).alias(f"more_{n}") for n, c in parts.items()], F.count_if(~F.col("counts")).alias("n_refused"))
    both = sessions.join(added, "id", "left")
    return both.select("id", "state", *[(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in MOST_ADDED], F.coalesce("n_refused", F.lit(0)).alias("n_refused"))


def topics(sessions: DataFrame, turns: DataFrame, last: int = LAST_TURNS) -> DataFrame:
    """(session_id, topic): the topic with a session's last turns below it, a line each. sessions: session_id, topic; turns: session_id, place, text. Only those turns are gathered."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("place")))
    tail = turns.withColumn("back", back).where(F.col("back") <= last).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))).alias("tail"))
    said = F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform("tail", lambda x: x["text"]), "\n")), F.lit(""))
    return sessions.join(tail, "session_id", "left").select("session_id", F.concat("topic", said).alias("topic"))


def audit_trail(actions: DataFrame) -> DataFrame:
    """(actor, operation, id, at, detail_hash): what was done, with the hash of its detail and never the detail; an actor that is not named is HUMAN. actions: actor, operation, id, at, detail (JSON text)."""
    from tessera.functions.text import digest

    return actions.select(F.coalesce("actor", F.lit("HUMAN")).alias("actor"), "operation", "id", "at", digest(F.coalesce("detail", F.lit("null"))).alias("detail_hash"))
