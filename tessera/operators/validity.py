"""Whether what was drafted may still be used: it is joined with what it rests on as that is now, and the first part that has changed is the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lifecycle import deny_reason

#: Phases in which research has ended without a result; statuses of what is in force. Fixed values.
STOPPED, IN_FORCE = ("INVALIDATED", "INTERRUPTED", "CANCELLED"), "ACTIVE"
#: What a report must reach: overall, in each dimension; the dimensions; checks that must all hold. Fixed values.
LEAST_OVERALL, LEAST_EACH = 80, 70
#: Parts that rows with the same message, room, run or owner are dealt over.
DEALS = 32
CRITICAL = ("no_permission_escalation", "honest_identity", "source_declared", "permission_declared")


def dealt_join(rows: DataFrame, known: DataFrame, on: str, key: str) -> DataFrame:
    """rows left-joined with known on a column that many rows may share: each value's rows are dealt over DEALS parts by a hash of their key, and known is repeated for each part."""
    parts = known.withColumn("_deal", F.explode(F.array(*[F.lit(n).cast("long") for n in range(DEALS)])))
    return rows.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(DEALS))).join(parts, [on, "_deal"], "left").drop("_deal")


def lost_sources(rows: DataFrame, key: str, ids: str, messages: DataFrame, missing_counts: bool = True) -> DataFrame:
    """(key, lost): rows one of whose source messages is deleted, or is not there. messages: id, deleted. No row's list is gathered: lists are exploded and summed."""
    each = rows.select(F.col(key).alias("row"), F.explode(ids).alias("id"))
    asked = messages.select("id", "deleted").join(each.select("id").distinct(), "id", "left_semi")
    found = dealt_join(each, asked, "id", "row")
    gone = F.coalesce("deleted", F.lit(missing_counts))
    return found.groupBy(F.col("row").alias(key)).agg(F.bool_or(gone).alias("lost")).where("lost")


def skill_version(text: Column, version: Column) -> Column:
    """What a batch remembers of the profile it was written with."""
    return F.sha2(F.concat_ws("\n", F.coalesce(version, F.lit(1)).cast("string"), text), 256)


def stale_runs(runs: DataFrame, now: DataFrame, versions: DataFrame, messages: DataFrame) -> DataFrame:
    """Research (id, owner_id, phase, config_revision, binding, version_id, privacy_revision, source_message_ids) with `stale` and the reason.

    now: owner_id, config_revision, binding, privacy_revision; versions: id, state. It is stale when it has stopped, when the settings or the connection are others, when its version is
    invalid, or when the privacy epoch is another and one of its own messages is deleted: another epoch alone stops nothing.
    """
    current = now.select("owner_id", *[F.col(c).alias(f"now_{c}") for c in ("config_revision", "binding", "privacy_revision")])
    both = runs.join(current, "owner_id", "left").join(versions.select(F.col("id").alias("version_id"), "state"), "version_id", "left")
    both = both.join(lost_sources(runs, "id", "source_message_ids", messages, missing_counts=False), "id", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    reason = (
        F.when(F.col("phase").isin(*STOPPED), "STOPPED").when(differs("config_revision"), "SETTINGS").when(differs("binding"), "CONNECTION").when(F.col("state") == "INVALIDATED", "VERSION")
        .when(differs("privacy_revision") & F.coalesce("lost", F.lit(False)), "SOURCES")
    )
    return both.select("id", reason.alias("reason"), reason.isNotNull().alias("stale"))


def batch_validity(batches: DataFrame, rooms: DataFrame, stale: DataFrame, models: DataFrame, epochs: DataFrame, skills: DataFrame, messages: DataFrame) -> DataFrame:
    """batch_id and deny_reason, null if the batch may be published.

    batches: batch_id, owner_id, conversation_id, research_id, connection_id, model_hash, privacy_revision, skill_id, skill_version, source_message_ids; rooms: id, deleted; stale: id, stale; models: connection_id, hash;
    epochs: owner_id, epoch; skills: id, status, text, version; messages: id, deleted. A batch without research or without a model hash is not held to them.
    """
    asked = lambda known, on: known.join(batches.select(on).distinct(), on, "left_semi")  # what no batch asks for is not repeated
    b = batches.select([c for c in batches.columns if c != "source_message_ids"])
    for on, known in (
        ("conversation_id", rooms.select(F.col("id").alias("conversation_id"), F.col("deleted").alias("room_gone"))), ("research_id", stale.select(F.col("id").alias("research_id"), "stale")),
        ("connection_id", models.select("connection_id", "hash")), ("owner_id", epochs.select("owner_id", "epoch")),
    ):
        b = dealt_join(b, asked(known, on), on, "batch_id")
    b = b.join(skills.select(F.col("id").alias("skill_id"), "status", skill_version(F.col("text"), F.col("version")).alias("now_version")), "skill_id", "left")
    b = b.join(lost_sources(batches, "batch_id", "source_message_ids", messages), "batch_id", "left")
    reason = deny_reason(
        room=~F.col("room_gone"), research=F.col("research_id").isNull() | ~F.col("stale"), model=F.col("model_hash").isNull() | (F.col("hash") == F.col("model_hash")),
        epoch=F.col("privacy_revision") == F.coalesce("epoch", F.lit(0)), skill=(F.col("status") == IN_FORCE) & (F.col("now_version") == F.col("skill_version")), sources=F.col("lost").isNull(),
    )
    return b.select("batch_id", reason.alias("deny_reason"))


def valid_grants(grants: DataFrame, profiles: DataFrame, tasks: DataFrame, evidence: DataFrame, protocol: str) -> DataFrame:
    """Active permits (id, owner_id, protocol, profile_id, content_hash, assessment_id, model_hash, evidence_ids, made) with `valid`.

    profiles: id, status, hash; tasks: id, status, passed; evidence: id, fine. A permit needs its protocol, its profile unchanged and in force, its assessment passed, and all of its evidence, of which
    there must be some.
    """
    active = grants.where(F.col("status") == IN_FORCE)
    each = active.select("id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select(F.col("id").alias("evidence_id"), "fine"), "evidence_id", "left")
    held = each.groupBy("id").agg(F.bool_and(F.coalesce("fine", F.lit(False))).alias("held"))
    both = active.join(profiles.select(F.col("id").alias("profile_id"), F.col("status").alias("profile_status"), "hash"), "profile_id", "left")
    both = both.join(tasks.select(F.col("id").alias("assessment_id"), F.col("status").alias("task_status"), "passed"), "assessment_id", "left").join(held, "id", "left")
    rule = (F.col("protocol") == protocol) & (F.coalesce("profile_status", F.lit(IN_FORCE)) == IN_FORCE) & (F.col("hash") == F.col("content_hash")) & (F.col("task_status") == "PASSED") & F.col("passed") & F.col("held")
    return both.select("id", "owner_id", "model_hash", "made", F.coalesce(rule, F.lit(False)).alias("valid"))


def unlocked(judged: DataFrame, models: DataFrame) -> DataFrame:
    """Per owner the newest valid permit for the model that is set now. judged: of valid_grants(); models: owner_id, hash."""
    able = judged.where("valid").join(models.select("owner_id", F.col("hash").alias("model_hash")), ["owner_id", "model_hash"], "left_semi")
    return able.groupBy("owner_id").agg(F.max_by("id", F.struct("made", "id")).alias("grant_id"))


def admitted(tasks: DataFrame, profiles: DataFrame, dimensions: Sequence[str], protocol: str) -> DataFrame:
    """Per profile the newest assessment that admits it. tasks: id, made, subject_id, kind, subject_type, owner_confirmed, status, protocol, report_protocol, passed, classification, report_version, report_hash,
    content_hash, overall, scores (map of dimension to score), checks (map of name to whether it holds), all_live, frozen_hash; profiles: id, hash, frozen_hash, fine.

    A report counts if it is live, of this protocol and this very version, reaches both thresholds in exactly the dimensions asked for, and holds all critical checks; the profile must be as it was assessed and
    what it rests on in force. What is unknown does not count.
    """
    frozen = (F.col("kind") == "QUALITY") & (F.col("subject_type") == "USER_SKILL") & F.col("owner_confirmed") & (F.col("status") == "PASSED") & (F.col("protocol") == protocol) & (F.col("report_protocol") == protocol)
    report = F.col("passed") & (F.col("classification") == "LIVE") & (F.col("report_version") == F.col("subject_id")) & (F.col("report_hash") == F.col("content_hash"))
    asked = F.array_sort(F.array(*map(F.lit, dimensions)))
    scores = (F.col("overall") >= LEAST_OVERALL) & (F.array_sort(F.map_keys("scores")) == asked) & F.forall(F.map_values("scores"), lambda s: s >= LEAST_EACH)
    checks = F.lit(True)
    for name in CRITICAL:
        checks &= F.coalesce(F.try_element_at("checks", F.lit(name)), F.lit(False))
    now = profiles.select(F.col("id").alias("subject_id"), F.col("hash").alias("now_hash"), F.col("frozen_hash").alias("now_frozen"), "fine")
    kept = F.col("all_live") & (F.col("frozen_hash") == F.col("now_frozen")) & (F.col("content_hash") == F.col("now_hash")) & F.col("fine")
    able = tasks.where(frozen & report & scores & checks).join(now, "subject_id").where(kept)
    return able.groupBy("subject_id").agg(F.max_by("id", F.struct("made", "id")).alias("assessment_id"))


def quality_ready(drafts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per draft (id, hash, version) the newest assessment that passed for this very text and version; null if none did. tasks: id, made, kind, subject_type (null: SKILL_IMPORT), subject_id, content_hash, status, passed, report_version, classification."""
    fit = (F.col("kind") == "QUALITY") & (F.coalesce("subject_type", F.lit("SKILL_IMPORT")) == "SKILL_IMPORT") & (F.col("status") == "PASSED") & F.col("passed") & (F.col("classification") == "LIVE")
    able = tasks.where(fit).select("made", F.col("id").alias("task"), F.col("subject_id").alias("id"), F.col("content_hash").alias("hash"), F.col("report_version").alias("version"))
    found = drafts.select("id", "hash", "version").join(able, ["id", "hash", "version"]).groupBy("id").agg(F.max_by("task", F.struct("made", "task")).alias("assessment_id"))
    return drafts.select("id").join(found, "id", "left")


def upgrades(existing: DataFrame, packaged: DataFrame, predecessors: DataFrame, notice: str) -> DataFrame:
    """existing (id, slug, source_version, builtin, version, text, permission) with `upgraded`: only a shipped text whose hash and version are those of a known predecessor is replaced, and gets the
    notice once; all else stays. packaged: id, slug, source_version, version, text; predecessors: id, version, text_hash."""
    new = packaged.select("id", "slug", "source_version", F.col("version").alias("new_version"), F.col("text").alias("new_text"))
    known = predecessors.select("id", "version", F.col("text_hash").alias("hash"), F.lit(True).alias("known")).distinct()
    both = existing.withColumn("hash", F.sha2("text", 256)).join(new, ["id", "slug", "source_version"], "left").join(known, ["id", "version", "hash"], "left")
    go = F.coalesce(F.col("builtin") & F.col("known") & F.col("new_text").isNotNull(), F.lit(False))
    permission = F.when(go & ~F.contains(F.coalesce("permission", F.lit("")), F.lit(notice)), F.concat(F.coalesce("permission", F.lit("")), F.lit(notice))).otherwise(F.col("permission"))
    return both.select("id", "slug", F.when(go, F.col("new_version")).otherwise(F.col("version")).alias("version"), F.when(go, F.col("new_text")).otherwise(F.col("text")).alias("text"), permission.alias("permission"), go.alias("upgraded"))
