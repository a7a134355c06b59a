"""Goals and the actions taken for them, as the outcome of ordered requests. A request counts only if the revision it expects is the present one.

A goal goes from PROPOSED (revision 1) to APPROVED (2) to REVOKED, or to REVOKED at once, and never back. So its whole history hangs on two events: the first request that
expects revision 1, and after an approval the first revocation that expects revision 2. Both are found by aggregation, and each request is judged against them in
its own row: no history is folded in one task, however many requests a goal has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The revision of a goal that was just proposed. Fixed value.
FIRST = 1


def turning_points(requests: DataFrame) -> DataFrame:
    """Per goal: `opened` (place and operation of the first request that met the proposal) and `revoked_at`, the place of the revocation that counted. requests: goal, place, revision, operation."""
    opened = requests.groupBy("goal").agg(F.min(F.when(F.col("revision") == FIRST, F.struct("place", "operation"))).alias("opened"))
    later = (F.col("revision") == FIRST + 1) & (F.col("operation") == "revoke") & (F.col("opened.operation") == "approve") & (F.col("place") > F.col("opened.place"))
    closed = requests.join(opened, "goal").groupBy("goal").agg(F.first("opened").alias("opened"), F.min(F.when(later, F.col("place"))).alias("closed"))
    revoked = F.when(F.col("opened.operation") == "revoke", F.col("opened.place")).otherwise(F.col("closed"))
    approved = F.when(F.col("opened.operation") == "approve", F.col("opened.place"))
    return closed.select("goal", approved.alias("approved_at"), revoked.alias("revoked_at"))


def judged_requests(requests: DataFrame) -> DataFrame:
    """requests (goal, place, revision, operation: approve or revoke) with what became of each: APPLIED, REPEATED (what it asks for stands, and it expects that revision or the one before), CONFLICT
    (another revision), or REVOKED (nothing comes after), and the revision after it. Requests with nulls take no effect and are CONFLICT."""
    at = requests.join(turning_points(requests), "goal", "left")
    since = lambda c: F.coalesce(F.col("place") > F.col(c), F.lit(False))
    now = F.lit(FIRST) + since("approved_at").cast("int") + since("revoked_at").cast("int")
    state = F.when(since("revoked_at"), "REVOKED").when(since("approved_at"), "APPROVED").otherwise("PROPOSED")
    target = F.when(F.col("operation") == "approve", "APPROVED").when(F.col("operation") == "revoke", "REVOKED")
    sure = lambda c: F.coalesce(c, F.lit(False))
    counts = sure(F.col("place") == F.col("approved_at")) | sure(F.col("place") == F.col("revoked_at"))
    expected = sure(F.col("revision") == now)
    stands = sure(state == target) & (expected | sure(F.col("revision") == now - 1))
    outcome = F.when(counts, "APPLIED").when(stands, "REPEATED").when(~expected, "CONFLICT").otherwise("REVOKED")
    return at.select("goal", "place", "revision", "operation", outcome.alias("outcome"), (now + counts.cast("int")).cast("long").alias("revision_after"))


def judged_actions(actions: DataFrame, requests: DataFrame) -> DataFrame:
    """actions (action, goal, place, user_approved) with `allowed`: whether the goal is approved at that place and the user said so."""
    points = turning_points(requests)
    at = actions.join(points, "goal", "left")
    open_ = F.coalesce(F.col("place") > F.col("approved_at"), F.lit(False)) & ~F.coalesce(F.col("place") > F.col("revoked_at"), F.lit(False))
    return at.withColumn("allowed", open_ & F.coalesce("user_approved", F.lit(False)))


def checked_actions(actions: DataFrame, checkins: DataFrame, requests: DataFrame) -> DataFrame:
    """Per action that was allowed: action, goal, state and outcome in the end. checkins: action, place, outcome (null takes the action back).

    An action ends with the first check-in that takes it back or with its goal, whichever comes first; the last report before that counts, and stays when the action ends with its goal.
    """
    live = judged_actions(actions, requests).where("allowed").select("action", "goal", F.col("place").alias("made"), "revoked_at")
    said = checkins.join(live, "action").where("place > made")
    before = F.coalesce(F.col("place") < F.col("revoked_at"), F.lit(True))
    ended = said.groupBy("action").agg(F.min(F.when(before & F.col("outcome").isNull(), F.col("place"))).alias("taken_back"))
    reports = said.join(ended, "action").where(before & F.coalesce(F.col("place") < F.col("taken_back"), F.lit(True)))
    last = reports.groupBy("action").agg(F.max_by("outcome", "place").alias("outcome"))
    both = live.join(ended, "action", "left").join(last, "action", "left")
    state = F.when(F.col("taken_back").isNotNull() | F.col("revoked_at").isNotNull(), "REVOKED").when(F.col("outcome").isNotNull(), "SELF_REPORTED").otherwise("APPROVED")
    return both.select("action", "goal", state.alias("state"), F.when(F.col("taken_back").isNull(), F.col("outcome")).alias("outcome"))
