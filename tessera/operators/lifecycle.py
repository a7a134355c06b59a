"""Life of evidence: admission, ingestion, the outbox, deletion through lineage, validity of what was made from it.

Every state is a fold of events: nothing is updated in place, and the order in which events arrive does not change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations of the audit log that begin a new privacy epoch. Fixed values.
EPOCH_OPERATIONS = ("EVIDENCE_DELETED", "CONSENT_REVOKED", "ROOM_DELETED")


def key_of(*parts: Column) -> Column:
    """The same id for the same parts, whoever computes it."""
    return F.sha2(F.concat_ws(":", *[x.cast("string") for x in parts]), 256)


def admissible(messages: DataFrame, withdrawn: DataFrame, existing: DataFrame) -> DataFrame:
    """Messages that become evidence: of users, not deleted, in no withdrawn room, not there yet. They wait as PENDING with an INGEST to be done.

    withdrawn: conversation_id; existing: evidence_id. A message that comes twice is admitted once.
    """
    able = messages.where("speaker = 'USER' and not deleted").join(withdrawn.select("conversation_id").distinct(), "conversation_id", "left_anti")
    new = able.withColumn("evidence_id", key_of(F.col("conversation_id"), F.col("sequence"))).join(existing.select("evidence_id"), "evidence_id", "left_anti")
    return new.select("evidence_id", "conversation_id", "sequence", F.lit("PENDING").alias("status"), F.lit("INGEST").alias("operation")).dropDuplicates(["evidence_id"])


def ingested(requests: DataFrame, deletions: DataFrame, key: Sequence[str], fingerprint: str, order: str) -> DataFrame:
    """Per request: ACCEPTED, DUPLICATE of the first with its key, CONFLICT with it, or REFUSED as the key was deleted, be it before anything arrived.

    deletions: the key's columns. The first request is that with the smallest `order`.
    """
    gone = deletions.select(*key).distinct().withColumn("gone", F.lit(True))
    first = requests.groupBy(*key).agg(F.min(F.struct(order, fingerprint)).alias("first"))
    both = requests.join(first, list(key)).join(gone, list(key), "left")
    outcome = (
        F.when(F.col("gone").isNotNull(), "REFUSED").when(F.col(order) == F.col(f"first.{order}"), "ACCEPTED").when(F.col(fingerprint).eqNullSafe(F.col(f"first.{fingerprint}")), "DUPLICATE").otherwise("CONFLICT")
    )
    return both.select(*key, order, outcome.alias("outcome"))


def outbox_state(attempts: DataFrame) -> DataFrame:
    """Per evidence: what is to be done (a deletion outdoes all else), how often it was tried, whether it is done, and the class of the last error if not.

    attempts: evidence_id, operation, applied, error, at. Attempts of an operation that is outdone do not count.
    """
    each = attempts.groupBy("evidence_id", "operation").agg(F.count("applied").alias("attempts"), F.bool_or("applied").alias("applied"), F.max_by("error", F.struct("at", "error")).alias("last_error"))
    chosen = each.groupBy("evidence_id").agg(F.min_by(F.struct("operation", "attempts", "applied", "last_error"), F.col("operation") != "DELETE").alias("x"))
    state = F.when(F.col("x.applied"), "APPLIED").when(F.col("x.attempts") > 0, "FAILED").otherwise("PENDING")
    return chosen.select("evidence_id", "x.operation", "x.attempts", state.alias("state"), F.when(state == "FAILED", F.col("x.last_error")).alias("error_class"))


def redacted_views(gone: DataFrame, views: dict[str, DataFrame]) -> DataFrame:
    """(view, id, redacted) for each row of each view (id), by one closure of deleted ids for all of them."""
    out = None
    for name, view in views.items():
        found = view.select("id").join(gone.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").select(F.lit(name).alias("view"), "id", F.col("hit").isNotNull().alias("redacted"))
        out = found if out is None else out.unionByName(found)
    return out


def stale_versions(versions: DataFrame, deleted: DataFrame) -> DataFrame:
    """(version, invalid, n_lost): a version is invalid once any evidence that it rests on is gone. versions: version, id; deleted: id."""
    found = versions.join(deleted.select("id").distinct().withColumn("lost", F.lit(1)), "id", "left")
    return found.groupBy("version").agg(F.count("lost").alias("n_lost")).withColumn("invalid", F.col("n_lost") > 0)


def manifest_valid(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Per manifest: whether each entry's recorded hash is the hash of what is there now. manifest: name, id, hash; current: id, hash."""
    found = manifest.join(current.select("id", F.col("hash").alias("now")), "id", "left")
    return found.groupBy("name").agg(F.bool_and(F.coalesce(F.col("hash") == F.col("now"), F.lit(False))).alias("valid"), F.count(F.lit(1)).alias("n_entries"))


def privacy_epoch(audit: DataFrame, owner: str, operation: Column, operations: Sequence[str] = EPOCH_OPERATIONS) -> DataFrame:
    """Per owner: the number of operations that began an epoch."""
    return audit.groupBy(owner).agg(F.count_if(operation.isin(*operations)).alias("epoch"))


def live_runs(publications: DataFrame, live: dict[str, DataFrame]) -> DataFrame:
    """Runs with a publication that still stands. publications: run, scope, id; live: scope -> ids of what stands there."""
    out = None
    for scope, ids in live.items():
        found = publications.where(F.col("scope") == scope).join(ids.select("id"), "id", "left_semi").select("run")
        out = found if out is None else out.union(found)
    return out.distinct()


def missing(expected: DataFrame, stored: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """What should be there, is not, and was not deleted."""
    return expected.join(stored.select(key), key, "left_anti").join(tombstones.select(key), key, "left_anti")


def deny_reason(room: Column, research: Column, model: Column, epoch: Column, skill: Column, sources: Column) -> Column:
    """Why a batch may no longer be used, null if it may. Each argument: whether that part is as it was; unknown counts as changed."""
    out = F.lit(None).cast("string")
    for name, holds in reversed([("ROOM", room), ("RESEARCH", research), ("MODEL", model), ("EPOCH", epoch), ("SKILL", skill), ("SOURCES", sources)]):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def unknown_fields(document: Column, allowed: Sequence[str]) -> Column:
    """Fields of a JSON object that are not allowed, by name; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(document), F.array(*map(F.lit, allowed))))


def reply_queue(waiting: DataFrame, running: DataFrame, room: str, order: Sequence[str | Column], most: int = 2) -> DataFrame:
    """The next replies to start: one per room, none in a room that is at work, as many as are free of `most`. A top-k report."""
    free = F.greatest(F.lit(0), F.lit(most) - running.agg(F.count(F.lit(1))).first()[0])
    able = waiting.join(running.select(room).distinct(), room, "left_anti")
    first = able.withColumn("_n", F.row_number().over(Window.partitionBy(room).orderBy(*order))).where("_n = 1").drop("_n")
    return first.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") <= free)
