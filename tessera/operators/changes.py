"""What a deletion or a correction of evidence changes, in all tables at once.

The evidence that goes is written once, as a delta, and every change follows from that one table: so messages, evidence, the outbox, research and
permits agree, and a run that is repeated gives the same changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.assembly import numbered
from tessera.shared import materialise

CHANGE = ("view", "id", "change", "detail")
#: What stands in the place of deleted messages. Fixed values.
OWN_GONE, REPLY_GONE = "[已删除]", "[关联来源已删除]"
#: Phases in which research is still going on. Fixed values.
UNDER_WAY = ("NEW", "SEARCHING", "VERIFYING", "GENERATING")


def _change(rows: DataFrame, view: str, id_: Column, change: str, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(view).alias("view"), id_.cast("string").alias("id"), F.lit(change).alias("change"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def withdrawn(requests: DataFrame, evidence: DataFrame, messages: DataFrame) -> DataFrame:
    """(evidence_id, message_id, conversation_id, text, domain) of the evidence that goes: only what is there and active can; a text means a correction. Of several
    requests for one piece that with the smallest place counts. requests: evidence_id, place, text, domain; evidence: id, message_id, status; messages: id, conversation_id."""
    first = requests.groupBy("evidence_id").agg(F.min_by(F.struct("text", "domain"), "place").alias("x")).select("evidence_id", "x.text", "x.domain")
    able = first.join(evidence.where("status = 'ACTIVE'").select(F.col("id").alias("evidence_id"), "message_id"), "evidence_id")
    rooms = messages.select(F.col("id").alias("message_id"), "conversation_id")
    return materialise(able.join(rooms, "message_id", "left").select("evidence_id", "message_id", "conversation_id", "text", "domain"), "withdrawn")


def change_set(gone: DataFrame, messages: DataFrame, runs: DataFrame, assessments: DataFrame, grants: DataFrame) -> DataFrame:
    """(view, id, change, detail): everything that follows from `gone` of withdrawn().

    - the message of a piece of evidence is blanked, and so is every reply of its room; the evidence waits for deletion without text, and a deletion goes to the outbox;
    - a correction becomes a new message at the end of its room, and evidence of the origin USER_CORRECTION that supersedes the old one;
    - research of the room loses its sources; assessments that rest on the evidence, and permits that rest on it or on those, are invalid.

    messages: id, conversation_id, sequence, speaker; runs: id, scope_id; assessments: id, evidence_ids; grants: id, evidence_ids, assessment_id.
    """
    rooms = gone.where("conversation_id is not null").select("conversation_id").distinct()
    own = messages.join(gone.select(F.col("message_id").alias("id")).distinct(), "id", "left_semi").where("speaker = 'USER'")
    replies = messages.where("speaker = 'AGENT'").join(rooms, "conversation_id", "left_semi")
    new = gone.where("text is not null and conversation_id is not null").select("conversation_id", "evidence_id", "text")
    placed = numbered(new, messages, "conversation_id", "evidence_id")
    resting = lambda t: t.select("id", F.explode("evidence_ids").alias("evidence_id")).join(gone.select("evidence_id"), "evidence_id", "left_semi").select("id").distinct()
    tasks = resting(assessments)
    permits = resting(grants).unionByName(grants.join(tasks.select(F.col("id").alias("assessment_id")), "assessment_id", "left_semi").select("id")).distinct()
    corrected = F.concat(F.lit("correction:"), F.col("evidence_id").cast("string"))
    out = [
        _change(own, "messages", F.col("id"), "BLANK", F.lit(OWN_GONE)),
        _change(replies, "messages", F.col("id"), "BLANK", F.lit(REPLY_GONE)),
        _change(placed, "messages", corrected, "ADD", F.concat_ws(":", F.col("conversation_id").cast("string"), F.col("sequence").cast("string"), F.sha2("text", 256))),
        _change(gone, "evidence", F.col("evidence_id"), "DELETE_PENDING"),
        _change(placed, "evidence", corrected, "USER_CORRECTION", F.col("evidence_id")),
        _change(gone, "outbox", F.col("evidence_id"), "DELETE"),
        _change(runs.join(rooms.select(F.col("conversation_id").alias("scope_id")), "scope_id", "left_semi"), "research", F.col("id"), "INVALIDATED"),
        _change(tasks, "assessments", F.col("id"), "INVALIDATED"),
        _change(permits, "grants", F.col("id"), "INVALIDATED"),
    ]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def cancelled_runs(runs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(id, phase) of the research of some scopes that is cancelled when only what is not published goes: what is under way, was never published, or has messages that wait.

    runs: id, scope_id, phase, n_published, n_waiting; scopes: scope_id.
    """
    open_ = F.col("phase").isin(*UNDER_WAY) | (F.coalesce("n_published", F.lit(0)) == 0) | (F.coalesce("n_waiting", F.lit(0)) > 0)
    return runs.join(scopes.select("scope_id").distinct(), "scope_id", "left_semi").where(open_).select("id", F.lit("CANCELLED").alias("phase"))
