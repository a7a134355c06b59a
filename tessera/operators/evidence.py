"""Evidence: admission, idempotency, snapshots, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import materialise
from tessera.sources.tables import REAL_ORIGINS


def refusal(actor: Column, owner: Column, subject: Column, origin: Column, purpose: Column, granted: Column) -> Column:
    """Why a piece of evidence may not be used, null if it may; the first rule that holds decides."""
    return (
        F.when((owner != subject) | ~actor.isin("HUMAN", "PERSONA"), "NOT_OWN")
        .when(~origin.isin(*REAL_ORIGINS), "ORIGIN")
        .when(~purpose.isin("ADMIT", "MIRROR", "SIMULATION"), "PURPOSE")
        .when((purpose == "ADMIT") & (actor != "HUMAN"), "NOT_HUMAN")
        .when((purpose == "SIMULATION") & ~granted, "NOT_GRANTED")
    )


def active_by_domain(evidence: DataFrame) -> DataFrame:
    return evidence.where("status = 'ACTIVE'").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def tracks(evidence: DataFrame, kind: Column, most: int = 20) -> DataFrame:
    """Per owner and track: how much active evidence supports it, and the first ids."""
    routed = evidence.where("status = 'ACTIVE'").withColumn("kind", kind).where("kind in ('SELF_REPORT', 'OBSERVATION')")
    routed = routed.withColumn("track", F.when(F.col("kind") == "SELF_REPORT", "PERCEIVED").otherwise("OBSERVED"))
    n = routed.groupBy("owner_id", "track").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("owner_id", "track").orderBy("id"))
    first = routed.withColumn("place", place).where(F.col("place") <= most).groupBy("owner_id", "track").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("first_ids"))
    return n.join(first, ["owner_id", "track"])


def outbox_order(outbox: DataFrame) -> DataFrame:
    """The order in which each actor's operations are applied: deletions first, then by arrival."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("operation") != "DELETE", "event_id"))
    return outbox.select("user_id", "event_id", "operation", place.alias("position"))


def conflicts(requests: DataFrame, key: list[str], fingerprint: Column, order: str) -> DataFrame:
    """Per key: how often it came, and whether with differing contents; the first content is the one that counts."""
    found = requests.withColumn("fp", fingerprint)
    return found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fp").alias("n_fingerprints"), F.min_by("fp", order).alias("first_fingerprint")).withColumn("conflict", F.col("n_fingerprints") > 1)


FAN_BITS, LEVELS = 12, 3  # ids below 2 ** 36 meet in one hash after three levels


def fingerprint(evidence: DataFrame, by: Sequence[str] = ("owner_id",), id_col: str = "id", line: Column | None = None) -> DataFrame:
    """Content address of each group's evidence: a tree of hashes over ranges of ids, so that no group is gathered; equal evidence has one whatever its order.

    A leaf hashes the lines (id:hash of the text, unless `line` says otherwise) of 4096 ids, a node the hashes of 4096 ranges below it, level by level until each group has one. Rows without an
    id or group are left out, repeats of a line count once; n_leaves says how many ranges of 4096 ids hold something.
    """
    line = F.concat_ws(":", F.col(id_col).cast("string"), F.sha2("text", 256)) if line is None else line
    known = evidence.where(F.col(id_col).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    hashed = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x["line"]), "\n"), 256)
    rows = known.select(*by, F.col(id_col).cast("long").alias("at"), line.alias("line"), F.lit(1).cast("long").alias("n"))
    level = 0
    while level < LEVELS or rows.where(F.col("at") > 0).limit(1).count():
        n = F.sum("n") if level else F.max("n")
        rows = rows.groupBy(*by, F.shiftright("at", FAN_BITS).alias("at")).agg(hashed(F.struct("at", "line")).alias("line"), n.alias("n"))
        level += 1
        if level >= LEVELS:
            rows = materialise(rows, "fingerprint")
    return rows.select(*by, F.col("line").alias("fingerprint"), F.col("n").alias("n_leaves"))


def snapshots(evidence: DataFrame, versions: DataFrame, by: Sequence[str] = ("owner_id", "track")) -> DataFrame:
    """Per group the version that its evidence has now: the active one with the same fingerprint, or a new one, named by it. versions: by, version_id, snapshot_hash, state."""
    now = fingerprint(evidence, by)
    active = versions.where("state = 'ACTIVE'").groupBy(*by, F.col("snapshot_hash").alias("fingerprint")).agg(F.min("version_id").alias("known"))
    both = now.join(active, [*by, "fingerprint"], "left")
    return both.select(*by, "fingerprint", F.coalesce("known", F.concat(F.lit("version_"), "fingerprint")).alias("version_id"), F.col("known").isNotNull().alias("reused"))


def valid_sets(sets: DataFrame, evidence: DataFrame, key: str, ids: str) -> DataFrame:
    """Whether every id of a set is active, of an accepted origin and with consent; an empty set is not."""
    fine = evidence.select(F.col("id").alias("_id"), ((F.col("status") == "ACTIVE") & F.col("origin").isin(*REAL_ORIGINS) & F.col("consent_scope").isNotNull()).alias("fine"))
    found = sets.select(key, F.explode_outer(ids).alias("_id")).join(fine, "_id", "left")
    return found.groupBy(key).agg(F.bool_and(F.coalesce("fine", F.lit(False))).alias("valid"))


def order_lineage(orders: DataFrame, items: DataFrame) -> DataFrame:
    """What came of what: customers of orders, orders of parts. Ids times four, plus 0 for customers, 1 for orders, 2 for parts."""
    made = orders.select((F.col("o_custkey") * 4).alias("parent_id"), (F.col("o_orderkey") * 4 + 1).alias("child_id"))
    return made.unionByName(items.select((F.col("l_orderkey") * 4 + 1).alias("parent_id"), (F.col("l_partkey") * 4 + 2).alias("child_id")))


def closure(edges: DataFrame, roots: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """Every node that the roots reach, the roots included; cycles end because a node enters the frontier once.

    State goes to the shared folder each turn, so the plan stays small and a lost executor costs no earlier turn.
    """
    links = materialise(edges.select(F.col(parent).alias("u"), F.col(child).alias("v")).where("v is not null").distinct(), "links")
    reached = frontier = materialise(roots.select(F.col(roots.columns[0]).alias("u")).distinct(), "closure")
    while True:
        frontier = materialise(frontier.join(links, "u").select(F.col("v").alias("u")).distinct().join(reached, "u", "left_anti"), "frontier")
        if not frontier.limit(1).count():
            return reached.select(F.col("u").alias("id"))
        reached = reached.unionByName(frontier)


def redacted_rooms(messages: DataFrame) -> DataFrame:
    """After a deletion in a room none of its agent replies stands."""
    hit = messages.where("deleted and speaker = 'USER'").select("conversation_id").distinct().withColumn("hit", F.lit(True))
    found = messages.join(hit, "conversation_id", "left")
    gone = F.col("deleted") | (F.col("hit").isNotNull() & (F.col("speaker") == "AGENT"))
    return found.select("conversation_id", "sequence", gone.alias("redacted"))


def deletable(messages: DataFrame, live: DataFrame) -> DataFrame:
    """Rooms and the live evidence that stands against deleting them."""
    held = messages.select("conversation_id").distinct().join(live, "conversation_id", "left")
    return held.groupBy("conversation_id").agg(F.count("id").alias("n_live")).withColumn("allowed", F.col("n_live") == 0)
