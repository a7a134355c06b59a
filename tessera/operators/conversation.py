"""Conversation views: order, previews, redaction, feeds, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

GONE_USER, GONE_AGENT = "[已删除]", "[关联来源已删除]"  # fixed values


def shown(text: Column, speaker: Column, deleted: Column) -> Column:
    return F.when(deleted & (speaker == "USER"), GONE_USER).when(deleted, GONE_AGENT).otherwise(text)


def latest(messages: DataFrame, room: str = "conversation_id", order: str = "sequence") -> DataFrame:
    """The last message of each room."""
    place = F.row_number().over(Window.partitionBy(room).orderBy(F.col(order).desc()))
    return messages.withColumn("_place", place).where("_place = 1").drop("_place")


def previews(messages: DataFrame) -> DataFrame:
    last = latest(messages)
    return last.select("conversation_id", "sequence", "speaker", F.when(F.col("deleted"), shown(F.lit(None), F.col("speaker"), F.col("deleted"))).otherwise(X.preview(F.col("text"))).alias("preview"))


def recent(messages: DataFrame, pinned: Column, most: int = 100) -> DataFrame:
    """The first rooms of the list: pinned ones, then by last activity, then by id, all descending."""
    rooms = messages.groupBy("conversation_id").agg(F.max("sequence").alias("updated"), F.count(F.lit(1)).alias("n_messages")).withColumn("pinned", pinned)
    return rooms.orderBy(F.desc("pinned"), F.desc("updated"), F.desc("conversation_id")).limit(most)


def view(messages: DataFrame) -> DataFrame:
    """Messages as shown, with what a retry would send: only live, waiting or failed user messages with a domain and a consent choice."""
    retry = (F.col("speaker") == "USER") & ~F.col("deleted") & F.col("reply_state").isin("WAITING", "FAILED") & F.col("request_domain").isNotNull() & F.col("remember_requested").isNotNull()
    return messages.select(
        "conversation_id", "sequence", "speaker", shown(F.col("text"), F.col("speaker"), F.col("deleted")).alias("text"), F.when(retry, F.col("text")).alias("retry_text"), F.when(retry, F.col("remember_requested")).alias("retry_remember")
    )


def context(messages: DataFrame, last: int = 12) -> DataFrame:
    """Per room: its last messages as one transcript, and how many came before."""
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("sequence")))
    placed = messages.withColumn("_back", back)
    line = F.when(F.col("_back") <= last, F.struct("sequence", F.concat_ws(": ", "speaker", "text").alias("line")))
    return placed.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("transcript"),
        F.count_if(F.col("_back") > last).alias("n_earlier"),
    )


def feed(messages: DataFrame, after_sequence: int, after_revision: Column) -> DataFrame:
    """What a client that has seen `after_sequence` still needs: newer messages, or all if something was redacted since its revision."""
    revisions = messages.groupBy("conversation_id").agg(F.count_if("deleted").alias("redactions"))
    found = messages.join(revisions, "conversation_id").withColumn("reset", after_revision < F.col("redactions"))
    return found.where(F.col("reset") | (F.col("sequence") > after_sequence)).select("conversation_id", "sequence", "reset")


def replied(messages: DataFrame) -> DataFrame:
    """State of user messages after a restart: replied if an agent message answers them directly or within their batch of four.

    The two keys are two joins; one join on either key would compare every pair.
    """
    user = messages.where("speaker = 'USER'").withColumn("batch", F.floor(F.col("sequence") / 4))
    agent = messages.where("speaker = 'AGENT'")
    direct = agent.select("conversation_id", (F.col("sequence") - 1).alias("sequence")).distinct().withColumn("direct", F.lit(True))
    batch = agent.select("conversation_id", F.floor(F.col("sequence") / 4).alias("batch")).distinct().withColumn("batched", F.lit(True))
    found = user.join(direct, ["conversation_id", "sequence"], "left").join(batch, ["conversation_id", "batch"], "left")
    return found.select("conversation_id", "sequence", F.when(F.col("direct").isNotNull() | F.col("batched").isNotNull(), "REPLIED").otherwise(F.when(F.col("reply_state") == "WAITING", "FAILED").otherwise(F.col("reply_state"))).alias("state"))


def merged(local: DataFrame, server: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A client's rows and the server's: the server's win."""
    mine, theirs = local.withColumnRenamed(value, "_mine"), server.withColumnRenamed(value, "_theirs")
    return mine.join(theirs, keys, "full").select(*keys, F.coalesce("_theirs", "_mine").alias(value))


def gaps(events: DataFrame, who: str, at: str, header_after: int) -> DataFrame:
    """Whether a message opens a new time header: the first, or so long after the one before."""
    before = F.lag(at).over(Window.partitionBy(who).orderBy(at, "event_id"))
    return events.select("event_id", F.coalesce(F.col(at) - before > header_after, F.lit(True)).alias("header"))
