"""Queries over event ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import scheduling as S
from tessera.sources.tables import LEDGER, ledger

NOON = 1_705_320_000_000_000  # 15 January 2024, 12:00 UTC, in microseconds


def sched_debounce_sessions(spark, d):
    return S.bursts(ledger(spark, d), 1800)


def sched_fair_queue(spark, d):
    jobs = ledger(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") == "view", F.col("us"))).alias("last_served"), F.min("us").alias("created"))
    return S.fair_queue(jobs.where("last_served is not null"), 20)


def sched_running_budget(spark, d):
    return S.budget(ledger(spark, d), 4000, 60)


def sched_charge_once(spark, d):
    return S.charged_once(ledger(spark, d), ["event_type", "k"])


def sched_reservations(spark, d):
    state = F.when(F.col("event_type") == "error", "NOT_SENT").when(F.col("event_type") == "purchase", "DISPATCHED").otherwise("RESERVED")
    return S.reserved(ledger(spark, d).withColumn("request_id", F.col("k")).withColumn("state", state))


def sched_presence(spark, d):
    beats = ledger(spark, d).select("user_id", F.col("k").alias("tab"), (F.col("event_type") != "error").alias("visible"), (F.col("event_type") == "click").alias("composing"), "us", "event_id")
    return S.present(beats, NOON, 3 * 24 * 3600)


def sched_epoch_fence(spark, d):
    rows = ledger(spark, d)
    epochs = rows.groupBy("user_id").agg(F.max("k").alias("now"))
    return S.fenced(rows.join(epochs, "user_id").withColumn("epoch", F.col("k")), F.col("now")).groupBy("user_id").agg(F.count_if("late").alias("n_late"), F.sum("tokens").alias("tokens"))


def sched_props_payload(spark, d):
    return ledger(spark, d).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def sched_recovery(spark, d):
    state = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "RUNNING").otherwise("COMPLETED")
    return ledger(spark, d).groupBy(S.recovered(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def sched_windows(spark, d):
    """Tumbling windows of a day per event type."""
    day = 86_400 * S.SECOND
    return ledger(spark, d).groupBy("event_type", F.floor(F.col("us") / day).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


SQL = {
    "sched_debounce_sessions": f"""WITH {LEDGER}, o AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < {1800 * S.SECOND} THEN 0 ELSE 1 END AS opens FROM ledger),
      b AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS burst FROM o) SELECT user_id, burst, count(*) AS n_events, min(us) AS first_at, max(us) AS last_at FROM b GROUP BY user_id, burst""",
    "sched_fair_queue": f"WITH {LEDGER} SELECT user_id AS id, max(CASE WHEN event_type = 'view' THEN us END) AS last_served, min(us) AS created FROM ledger GROUP BY user_id HAVING last_served IS NOT NULL ORDER BY last_served, created, id LIMIT 20",
    "sched_running_budget": f"""WITH {LEDGER}, r AS (SELECT event_id, user_id, CAST(sum(tokens) OVER w AS BIGINT) AS used, count(*) OVER w AS n FROM ledger WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT event_id, user_id, used, CASE WHEN n > 60 THEN 'MESSAGE_LIMIT' WHEN used > 4000 THEN 'TOKEN_LIMIT' END AS paused FROM r""",
    "sched_charge_once": f"WITH {LEDGER}, f AS (SELECT user_id, tokens FROM ledger QUALIFY row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY us, event_id) = 1) SELECT user_id, count(*) AS n_calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY user_id",
    "sched_reservations": f"WITH {LEDGER}, l AS (SELECT user_id, event_type FROM ledger QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY us DESC, event_id DESC) = 1) SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n_requests FROM l GROUP BY user_id",
    "sched_presence": f"""WITH {LEDGER}, l AS (SELECT * FROM ledger WHERE us <= {NOON} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY us DESC, event_id DESC) = 1)
      SELECT user_id, bool_or(event_type NOT IN ('error', 'click') AND us + {3 * 24 * 3600 * S.SECOND} > {NOON}) AS present FROM l GROUP BY user_id""",
    "sched_epoch_fence": f"WITH {LEDGER}, e AS (SELECT *, max(k) OVER (PARTITION BY user_id) AS now FROM ledger) SELECT user_id, count(*) FILTER (WHERE k < now) AS n_late, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY user_id",
    "sched_props_payload": f"WITH {LEDGER} SELECT event_type, k, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM ledger GROUP BY event_type, k",
    "sched_recovery": "SELECT CASE event_type WHEN 'view' THEN 'INTERRUPTED' WHEN 'click' THEN 'PAUSED' ELSE 'COMPLETED' END AS state, count(*) AS n FROM events GROUP BY 1",
    "sched_windows": f"WITH {LEDGER} SELECT event_type, us // {86_400 * S.SECOND} AS day, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM ledger GROUP BY 1, 2",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith("sched_")]
