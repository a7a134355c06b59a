"""Queries on personal assessments: orders are the questions of fifty tasks, each with four arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assessment as A
from tessera.sources.tables import table

TASKS = 50


def _key():
    return F.col("o_orderkey")


def _choice(n):
    return F.element_at(F.array(*map(F.lit, A.CHOICES)), (n % 3 + 1).cast("int"))


def _questions(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % TASKS).alias("task"), _key().alias("question_id"), _choice(_key()).alias("choice"), (_key() % 25 == 0).alias("disputed"), (_key() % 811 != 5).alias("reference_valid"), "o_custkey", "o_orderpriority")


def _predictions(spark, d):
    """Four answers to each question; some choices and reasons are missing, some questions were not asked, some references not given."""
    each = table(spark, d, "orders").select("*", F.posexplode(F.array(*map(F.lit, A.ARMS))).alias("i", "arm"))
    choice = F.when(_key() % 307 == 1, "D").when((F.col("arm") == "D") & (_key() % 9 != 0), _choice(_key())).otherwise(_choice(F.floor(_key() / (F.col("i") + 2))))
    asked = F.when(_key() % 401 == 2, -_key()).otherwise(_key())
    return each.select((F.col("o_custkey") % TASKS).alias("task"), "arm", asked.alias("question_id"), choice.alias("choice"), F.when(_key() % 503 != 3, F.col("o_orderpriority")).otherwise("　").alias("reason"), F.array((F.col("o_custkey") % 10).cast("string")).alias("refs"))


def _read(spark, d):
    given = _questions(spark, d).select("task").distinct().select("task", F.explode(F.array(F.lit("B2"), F.lit("D"))).alias("arm"), F.explode(F.array(*[F.lit(str(k)) for k in range(8)])).alias("ref"))
    return A.read_predictions(_predictions(spark, d), _questions(spark, d), given)


def eval_prediction_faults(spark, d):
    return _read(spark, d).select("task", "arm", "question_id", "references_valid", "fault")


def _graded(spark, d):
    """The judge sees labels only; scores follow from the question and the label's place."""
    labels = A.labelled(_read(spark, d).where("fault is null"), 17)
    scores = F.map_from_arrays(F.array(*map(F.lit, list(A.WEIGHTS)[1:])), F.array(*[(F.col("question_id") * k % 31 + 70).cast("double") for k in (3, 5, 7, 11)]))
    judged = _questions(spark, d).select("task", "question_id", F.explode(F.sequence(F.lit(1), F.lit(len(A.ARMS)))).alias("label"), scores.alias("scores"), (F.col("question_id") % 97 != 0).alias("critical_safe"))
    return A.grades(labels, _questions(spark, d).select("task", "question_id", "choice"), judged)


def eval_grades(spark, d):
    return _graded(spark, d).groupBy("task", "arm", "dim").agg(F.sum("score").cast("long").alias("sum"), F.count_if("safe").alias("n_safe"), F.count(F.lit(1)).alias("n"))


def _ledger(spark, d):
    q = _questions(spark, d)
    reviews = q.where("question_id % 3 <> 0").select("task", "question_id", F.col("question_id").alias("at"), (F.col("question_id") % 40 != 1).alias("accepted"), F.col("o_orderpriority").alias("comment"))
    return A.review_ledger(A.required_reviews(q, F.col("disputed")), reviews, q)


def eval_review_ledger(spark, d):
    return _ledger(spark, d)


def eval_personal_reports(spark, d):
    """Means are taken over as many items as a fiftieth of all orders."""
    q = _questions(spark, d)
    items = max(1, q.count() // TASKS)
    live = q.select("task").distinct().withColumn("all_live", F.col("task") % 7 != 0)
    return A.reports(_graded(spark, d), q, _ledger(spark, d), live, items)


def eval_issues(spark, d):
    return A.issues(_graded(spark, d))


FACTS = """q AS (SELECT o_custkey % 50 AS task, o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, ['A', 'B', 'C'][CAST(o_orderkey % 3 AS INT) + 1] AS own FROM orders),
      r AS (SELECT task, arm, i, k, own, CASE WHEN k % 401 = 2 THEN -k ELSE k END AS question_id, CASE WHEN k % 307 = 1 THEN 'D' WHEN i = 3 AND k % 9 <> 0 THEN own ELSE ['A', 'B', 'C'][CAST(k // (i + 2) % 3 AS INT) + 1] END AS choice, i >= 2 AND c % 10 <= 7 AS refs
        FROM q, (VALUES ('B0', 0), ('B1', 1), ('B2', 2), ('D', 3)) a(arm, i)),
      f AS (SELECT *, CASE WHEN k % 401 = 2 AND k > 0 THEN 'QUESTION' WHEN choice = 'D' THEN 'CHOICE' WHEN k % 503 = 3 THEN 'REASON' END AS fault FROM r)"""
GRADED = FACTS + """, g AS (SELECT task, arm, question_id, refs AND question_id % 97 <> 0 AS safe, unnest(['decisions', 'values', 'consistency', 'style', 'boundaries']) AS dim,
        unnest([CASE WHEN choice = own THEN 100 ELSE 0 END, question_id * 3 % 31 + 70, question_id * 5 % 31 + 70, question_id * 7 % 31 + 70, question_id * 11 % 31 + 70]) AS score FROM f WHERE fault IS NULL)"""
LEDGER = """m AS (SELECT task, k FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY sha256(task || ':' || k)) AS place FROM q) WHERE place <= 12 OR k % 25 = 0),
      v AS (SELECT task, k, k % 40 <> 1 AS accepted, k % 40 <> 1 OR length(p) >= 8 AS fine FROM q WHERE k % 3 <> 0),
      led AS (SELECT task, count(m.k) AS required, count(v.k) AS reviewed, count(*) FILTER (WHERE m.k IS NOT NULL AND v.k IS NULL) = 0 AS complete, bool_and(coalesce(accepted, true)) AS agreed FROM m FULL JOIN (SELECT * FROM v WHERE fine) v USING (task, k) GROUP BY task)"""
SQL = {
    "eval_prediction_faults": f"WITH {FACTS} SELECT task, arm, question_id, refs AS references_valid, fault FROM f",
    "eval_grades": f"WITH {GRADED} SELECT task, arm, dim, CAST(sum(score) AS BIGINT) AS sum, count(*) FILTER (WHERE safe) AS n_safe, count(*) AS n FROM g GROUP BY task, arm, dim",
    "eval_review_ledger": f"WITH {FACTS}, {LEDGER} SELECT led.task, required, reviewed, coalesce(n, 0) AS n_refused, complete, agreed FROM led LEFT JOIN (SELECT task, count(*) FILTER (WHERE NOT fine) AS n FROM v GROUP BY task) x ON x.task = led.task",
    "eval_personal_reports": f"""WITH {GRADED}, {LEDGER}, n AS (SELECT greatest(1, count(*) // 50) AS items FROM q),
      d AS (SELECT task, arm, dim, sum(score) / (SELECT items FROM n)::DOUBLE AS mean FROM g GROUP BY task, arm, dim),
      t AS (SELECT task, arm, round(sum(mean * CASE dim WHEN 'decisions' THEN 0.30::DOUBLE WHEN 'values' THEN 0.25::DOUBLE WHEN 'consistency' THEN 0.20::DOUBLE WHEN 'style' THEN 0.15::DOUBLE ELSE 0.10::DOUBLE END), 6) AS total, round(min(mean), 6) AS least FROM d GROUP BY task, arm),
      w AS (SELECT task, max(total) FILTER (WHERE arm = 'D') AS overall, max(total) FILTER (WHERE arm <> 'D') AS best_baseline, max(least) FILTER (WHERE arm = 'D') AS least FROM t GROUP BY task),
      e AS (SELECT task, min(c) = (SELECT items FROM n) AND count(*) = 4 AS arms_complete, bool_and(s) FILTER (WHERE arm = 'D') AS safe FROM (SELECT task, arm, count(DISTINCT question_id) AS c, bool_and(safe) AS s FROM g GROUP BY task, arm) GROUP BY task),
      a AS (SELECT task, count(*) = (SELECT items FROM n) AND bool_and(k % 811 <> 5) AS answers_valid FROM q GROUP BY task)
      SELECT w.task, overall, best_baseline, least, answers_valid, arms_complete, safe, complete AS reviews_complete, agreed, w.task % 7 <> 0 AS all_live, overall > best_baseline AS above_baselines,
        overall >= 85 AND least >= 75 AND answers_valid AND arms_complete AND safe AND complete AND agreed AND w.task % 7 <> 0 AND overall > best_baseline AS passed
      FROM w JOIN e ON e.task = w.task JOIN a ON a.task = w.task JOIN led ON led.task = w.task""",
    "eval_issues": f"WITH {GRADED} SELECT task, dim, question_id FROM g WHERE arm = 'D' AND score < 75",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith("eval_")]
