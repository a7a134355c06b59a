"""Queues, sessions, budgets and ledgers, as windows over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def bursts(events: DataFrame, gap: int, who: str = "user_id", at: str = "us") -> DataFrame:
    """Runs of events that follow each other within `gap` seconds."""
    order = Window.partitionBy(who).orderBy(at, "event_id")
    opens = F.coalesce((F.col(at) - F.lag(at).over(order) >= gap * SECOND).cast("int"), F.lit(1))
    numbered = events.withColumn("opens", opens).withColumn("burst", F.sum("opens").over(order))
    return numbered.groupBy(who, "burst").agg(F.count(F.lit(1)).alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def fair_queue(jobs: DataFrame, slots: int) -> DataFrame:
    """The jobs that go next: longest not served first, then oldest, then by id."""
    return jobs.orderBy("last_served", "created", "id").limit(slots)


def budget(ledger: DataFrame, tokens: int, messages: int) -> DataFrame:
    """Running use per actor and the first limit that a charge breaks, if any."""
    so_far = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    used, n = F.sum("tokens").over(so_far), F.count(F.lit(1)).over(so_far)
    paused = F.when(n > messages, "MESSAGE_LIMIT").when(used > tokens, "TOKEN_LIMIT")
    return ledger.select("event_id", "user_id", used.alias("used"), paused.alias("paused"))


def charged_once(ledger: DataFrame, key: list[str]) -> DataFrame:
    """Tokens per actor when each call counts once, by its first entry."""
    first = ledger.groupBy("user_id", *key).agg(F.min_by("tokens", F.struct("us", "event_id")).alias("tokens"))
    return first.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens").alias("tokens"))


def reserved(ledger: DataFrame) -> DataFrame:
    """Requests per actor that count against its limit: reserved or dispatched, each key once, not those cancelled before they were sent."""
    last = ledger.groupBy("user_id", "request_id").agg(F.max_by("state", F.struct("us", "event_id")).alias("state"))
    return last.groupBy("user_id").agg(F.count_if(F.col("state") != "NOT_SENT").alias("n_requests"))


def present(beats: DataFrame, at: int, seconds: int) -> DataFrame:
    """Actors with a view that is visible, not composing, and not expired at an instant; the last beat of each view counts."""
    last = beats.where(F.col("us") <= at).groupBy("user_id", "tab").agg(F.max_by(F.struct("visible", "composing", "us"), F.struct("us", "event_id")).alias("x"))
    fine = F.col("x.visible") & ~F.col("x.composing") & (F.col("x.us") + seconds * SECOND > at)
    return last.groupBy("user_id").agg(F.bool_or(fine).alias("present"))


def fenced(results: DataFrame, epochs: Column) -> DataFrame:
    """Results of an older epoch than their session's are dropped; what they used still counts."""
    late = F.col("epoch") < epochs
    return results.withColumn("late", late)


def recovered(state: Column) -> Column:
    """What a restart makes of work in flight."""
    return F.when(state.isin("QUEUED", "GENERATING", "DELIVERING"), "INTERRUPTED").when(state == "RUNNING", "PAUSED").otherwise(state)
