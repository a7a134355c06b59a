"""The event-log operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream; ts is made an instant, as watermarks need one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Debounced bursts per user."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select("user_id", F.col("w.start").alias("first_at"), "n_events")


def windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per event type in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, however often it is delivered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def budgets(events: DataFrame, limit: int) -> DataFrame:
    """Running token use per user; a row when a user first passes the limit."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, paused = state.get if state.exists else (0, False)
        used += int(sum(b["value"].floordiv(1).sum() for b in batches))
        passes = used > limit and not paused
        state.update((used, paused or passes))
        if passes:
            yield pd.DataFrame({"user_id": [key[0]], "used": [used]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, used long", "used long, paused boolean", "append", GroupStateTimeout.NoTimeout)
