"""Streams give what the batch operators give on the same events."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from tessera.operators import scheduling as S
from tessera.sources.tables import ledger
from tessera.streaming import sessions


def _run(df, name, mode, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def _source(spark, sf_dir, tmp_path):
    (tmp_path / "events").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "events")
    return sessions.events_stream(spark, str(tmp_path / "events"), spark.read.parquet(f"{sf_dir}/events.parquet").schema)


def test_bursts(spark, sf_dir, tmp_path):
    got = _run(sessions.bursts(_source(spark, sf_dir, tmp_path)), "bursts", "complete", tmp_path)
    want = S.bursts(ledger(spark, sf_dir), 1800)
    assert got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_events")).exceptAll(want.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_events"))).count() == 0


def test_windows(spark, sf_dir, tmp_path):
    got = _run(sessions.windows(_source(spark, sf_dir, tmp_path)), "windows", "complete", tmp_path)
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_first_seen(spark, sf_dir, tmp_path):
    got = _run(sessions.first_seen(_source(spark, sf_dir, tmp_path), ["event_id"]), "seen", "append", tmp_path)
    assert got.count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").distinct().count()


def test_budgets(spark, sf_dir, tmp_path):
    got = _run(sessions.budgets(_source(spark, sf_dir, tmp_path), 1000), "budgets", "append", tmp_path)
    want = ledger(spark, sf_dir).groupBy("user_id").agg(F.sum("tokens").alias("used")).where("used > 1000")
    assert {r["user_id"] for r in got.collect()} == {r["user_id"] for r in want.collect()}
