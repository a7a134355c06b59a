"""Evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import similar as N
from tessera.sources.tables import table

WEIGHTS = {"decisions": 0.30, "values": 0.25, "consistency": 0.20, "style": 0.15, "boundaries": 0.10}


def _cases(spark, d):
    """Every document is a memory; those whose id is divisible by 100 are cases too."""
    docs = table(spark, d, "documents")
    choice = F.when(F.length("text") % 3 == 0, "yes").when(F.length("text") % 3 == 1, "no").otherwise("maybe")
    memories = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("owner_id"), F.col("lang").alias("domain"), F.col("doc_id").alias("occurred"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("occurred_text"), F.col("text").alias("content"), choice.alias("choice"))
    cases = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("case_id"), F.col("source").alias("owner_id"), F.col("lang").alias("domain"), F.col("doc_id").alias("occurred"), F.col("text").alias("question"), F.array(F.lit("yes"), F.lit("no")).alias("options"), F.when(F.length("text") % 2 == 0, "yes").otherwise("no").alias("reference"))
    return memories, cases


def eval_four_arm(spark, d):
    return E.four_arms(*_cases(spark, d))


def eval_arm_summary(spark, d):
    """Answers scored by choice and by a rubric of two phrases of the question's language; some arms have not answered, some answers failed."""
    memories, cases = _cases(spark, d)
    scored = E.four_arms(memories, cases).join(cases.select("case_id", "reference", "owner_id", F.col("domain").alias("session_id")), "case_id")
    status = F.when(F.col("arm").isin("B0"), "MISSING").when(F.col("case_id") % 700 == 0, "FAILED").otherwise("COMPLETED")
    said = F.array(F.concat(F.lit("I say "), F.col("choice")), F.concat(F.lit("as they are "), F.col("session_id")))
    rubric = F.when(F.col("case_id") % 300 != 0, F.array(F.concat(F.lit("SAY "), F.col("reference")), F.lit("are E"))).otherwise(F.array().cast("array<string>"))
    return E.arm_summary(scored.withColumn("status", status).withColumn("score", E.primary_score(F.col("choice"), F.col("reference"), said, rubric)))


def _orders(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("session_id"), (F.col("o_totalprice") / 1000).alias("value"), F.substring("o_orderpriority", 1, 1).alias("arm"))


def eval_clustered_mean(spark, d):
    return E.clustered_mean(_orders(spark, d), "owner_id", "session_id", "value").select(F.round("mean", 5).alias("mean"), "n_users")


def eval_strongest_baseline(spark, d):
    means = _orders(spark, d).groupBy("arm").agg(F.round(F.avg("value"), 2).alias("mean"))
    return E.strongest(means)


def _scored(spark, d):
    """Lines of an order as the arms' answers to a case; returned ones failed."""
    item, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    arm = F.element_at(F.array(*map(F.lit, E.ARMS)), ((F.col("l_linenumber") - 1) % 4 + 1).cast("int"))
    rows = item.join(orders, item.l_orderkey == orders.o_orderkey)
    return rows.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 40).alias("owner_id"), F.col("o_custkey").alias("session_id"), arm.alias("arm"), F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED").alias("status"), (F.col("l_quantity") / 50).alias("score"))


def eval_paired_differences(spark, d):
    out = E.paired_differences(_scored(spark, d))
    return out.select("case_id", "owner_id", "session_id", "baseline", F.round("difference", 6).alias("difference"))


def eval_bootstrap_ci(spark, d):
    return E.bootstrap(E.paired_differences(_scored(spark, d)), seed=1729)


def eval_split_windows(spark, d):
    orders = table(spark, d, "orders")
    split = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), "train").when((F.col("o_orderdate") < F.lit("1997-06-01").cast("timestamp")) | (F.col("o_custkey") % 7 == 3), "dev").otherwise("holdout")
    late = F.when((F.col("o_custkey") % 7 == 5) & (F.col("o_orderkey") % 3 == 0), "train").otherwise(split)
    return E.overlapping(orders.select(F.col("o_custkey").alias("owner_id"), late.alias("split"), F.col("o_orderdate").alias("at")))


def eval_near_duplicates(spark, d):
    return N.near_questions(_questions(spark, d))


def _questions(spark, d):
    """The benchmark in three splits of four owners, and in another split each question with every twentieth letter changed, every fifth one much, every seventh one not at all."""
    b = table(spark, d, "benchmark")
    changed = F.when(F.col("item_id") % 7 == 0, F.col("text")).when(F.col("item_id") % 5 == 0, F.regexp_replace("text", r"(\w\w\w)(\w)", "$1q")).otherwise(F.regexp_replace("text", r"(?s)(.{39}).", "$1q"))
    split = F.element_at(F.array(*map(F.lit, ("train", "dev", "holdout"))), (F.col("item_id") % 3 + 1).cast("int"))
    rows = b.select("item_id", F.col("item_id") % 4, split, "text").toDF("item_id", "owner_id", "split", "text")
    again = b.select(F.col("item_id") + 1_000_000_000, F.col("item_id") % 4, F.when(F.col("item_id") % 2 == 0, "dev").otherwise("holdout"), changed)
    return rows.union(again)


def eval_crossing_questions(spark, d):
    return N.crossing_questions(_questions(spark, d))


def eval_violations(spark, d):
    """Orders as records of a paired data set: memories and cases of their customers, with faults by key."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    case = key % 4 == 0
    split = F.when(key % 31 == 5, "other").when(case, F.when(key % 8 == 0, "dev").otherwise("holdout")).otherwise("train")
    reference = F.struct(F.when(key % 17 == 1, "D").otherwise("A").alias("choice"), F.when(key % 19 == 2, F.lit(None)).otherwise(F.array(F.lit("x"))).alias("reasons"))
    records = o.select(
        F.when(key % 37 != 3, key).otherwise(key - 1).alias("id"), F.when(case, "case").when(key % 41 == 4, "note").otherwise("memory").alias("kind"), F.when(key % 43 != 5, F.col("o_custkey")).alias("owner_id"),
        key.alias("session_id"), split.alias("split"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(key % 23 == 4, "").otherwise("T00:00:00Z")).alias("occurred_at"),
        F.element_at(F.array(*map(F.lit, ("REAL_USER_MESSAGE", "USER_SELF_REPORT", "SIMULATED_DIALOGUE"))), (F.when(key % 29 == 6, 2).otherwise(key % 2) + 1).cast("int")).alias("source_origin"),
        F.when(key % 47 == 7, F.lit(-1)).otherwise(F.col("o_custkey")).alias("subject_id"), F.when(key % 53 != 8, "PFE_TRAINING").alias("consent_purpose"), F.array(F.lit("A"), F.lit("B")).alias("options"), reference.alias("reference"),
    )
    return E.violations(records).where("rule <> 'n_windows'").select("rule", F.col("id").cast("long").alias("id"))


def eval_weighted_gate(spark, d):
    item = table(spark, d, "lineitem")
    dim = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return E.weighted_gate(item.select(F.col("l_suppkey").alias("task"), dim.alias("dim"), F.col("l_quantity").alias("score")), WEIGHTS, 100, 28.0, 20.0)


def eval_quality_gate(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    graded = docs.join(labels, "doc_id").groupBy("source").agg(F.round(F.avg(F.col("quality") * 100.0), 4).alias("overall"), F.bool_and(F.col("toxic") == 0).alias("all_safe"), F.count(F.lit(1)).alias("n"))
    return graded.withColumn("passed", (F.col("overall") >= 80) & F.col("all_safe"))


def eval_review_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    sampled = E.hash_sample(rows, F.col("doc_id"), "lang", 12).select("doc_id", "lang")
    disputed = rows.join(table(spark, d, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")
    return sampled.union(disputed).distinct()


ORDERS = "orders_of AS (SELECT c_nationkey AS owner_id, c_custkey AS session_id, o_totalprice / 1000 AS value, substring(o_orderpriority, 1, 1) AS arm FROM orders JOIN customer ON o_custkey = c_custkey)"
TERMS = r"list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+'))"
FOUR = f"""docs AS (SELECT *, {TERMS} AS terms, CASE length(text) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'maybe' END AS choice FROM documents),
      c AS (SELECT * FROM docs WHERE doc_id % 100 = 0),
      a AS (SELECT c.doc_id AS case_id, m.doc_id AS id, m.choice, m.lang = c.lang AS same, row_number() OVER (PARTITION BY c.doc_id ORDER BY m.doc_id) AS first,
        row_number() OVER (PARTITION BY c.doc_id ORDER BY len(list_intersect(m.terms, c.terms)) DESC, m.doc_id) AS best FROM c JOIN docs m ON m.source = c.source AND m.doc_id < c.doc_id),
      e AS (SELECT 'B1' AS arm, case_id, id, choice FROM a WHERE first = 1 UNION ALL SELECT 'B2', case_id, id, choice FROM a WHERE best <= 2 UNION ALL SELECT 'D', case_id, id, choice FROM a WHERE same),
      p AS (SELECT arm, case_id, max_by(choice, id) AS choice, max(id) AS evidence_id FROM e WHERE choice IN ('yes', 'no') GROUP BY arm, case_id),
      four AS (SELECT x.arm, c.doc_id AS case_id, c.source, c.lang, coalesce(p.choice, 'ABSTAIN') AS choice, p.evidence_id, CASE WHEN length(text) % 2 = 0 THEN 'yes' ELSE 'no' END AS reference
        FROM c CROSS JOIN (VALUES ('B0'), ('B1'), ('B2'), ('D')) x(arm) LEFT JOIN p ON p.arm = x.arm AND p.case_id = c.doc_id)"""
SQL = {
    "eval_four_arm": f"WITH {FOUR} SELECT arm, case_id, choice, evidence_id FROM four",
    "eval_arm_summary": f"""WITH {FOUR}, r AS (SELECT *, CAST(choice = reference AS INT) AS hit, CASE WHEN lang LIKE 'e%' THEN 1 ELSE 0 END AS told FROM four),
      s AS (SELECT *, CASE WHEN case_id % 300 = 0 THEN hit ELSE (hit + (hit + told) / 2.0::DOUBLE) / 2 END AS score, CASE WHEN arm = 'B0' THEN 'MISSING' WHEN case_id % 700 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM r)
      SELECT arm, count(*) AS expected, count(*) FILTER (WHERE status = 'COMPLETED') AS completed, count(*) FILTER (WHERE status = 'MISSING') AS missing, count(*) FILTER (WHERE status = 'FAILED') AS failed,
        max(mean) AS mean FROM s LEFT JOIN (SELECT arm, round(avg(m), 6) AS mean FROM (SELECT arm, source, avg(m) AS m FROM (SELECT arm, source, lang, avg(score) AS m FROM s WHERE status = 'COMPLETED' GROUP BY arm, source, lang) GROUP BY arm, source) GROUP BY arm) USING (arm) GROUP BY arm""",
    "eval_violations": """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 37 <> 3 THEN o_orderkey ELSE o_orderkey - 1 END AS id, o_orderkey % 4 = 0 AS is_case, o_orderkey % 4 <> 0 AND o_orderkey % 41 <> 4 AS memory, o_orderkey % 43 <> 5 AS owned FROM orders)
      SELECT 'a_fields' AS rule, id FROM r WHERE NOT owned UNION ALL SELECT 'b_kind', id FROM r WHERE NOT is_case AND NOT memory UNION ALL SELECT 'c_split', id FROM r WHERE k % 31 = 5
      UNION ALL SELECT 'd_instant', id FROM r WHERE k % 23 = 4 UNION ALL SELECT 'e_origin', id FROM r WHERE memory AND k % 29 = 6 UNION ALL SELECT 'f_subject', id FROM r WHERE memory AND (k % 47 = 7 OR NOT owned)
      UNION ALL SELECT 'g_consent', id FROM r WHERE memory AND k % 53 = 8 UNION ALL SELECT 'h_memory_split', id FROM r WHERE memory AND k % 31 = 5 UNION ALL SELECT 'j_reference', id FROM r WHERE is_case AND k % 17 = 1
      UNION ALL SELECT 'k_rubric', id FROM r WHERE is_case AND k % 19 = 2 UNION ALL SELECT 'l_duplicate', id FROM r GROUP BY id HAVING count(*) > 1""",
    "eval_clustered_mean": f"WITH {ORDERS}, s AS (SELECT owner_id, avg(value) AS m FROM orders_of GROUP BY owner_id, session_id), u AS (SELECT avg(m) AS m FROM s GROUP BY owner_id) SELECT round(avg(m), 5) AS mean, count(*) AS n_users FROM u",
    "eval_strongest_baseline": f"WITH {ORDERS}, m AS (SELECT arm, round(avg(value), 2) AS mean FROM orders_of GROUP BY arm) SELECT arm AS strongest, mean AS best_mean FROM m ORDER BY mean DESC, arm LIMIT 1",
    "eval_paired_differences": """WITH s AS (SELECT o_orderkey AS case_id, o_custkey % 40 AS owner_id, o_custkey AS session_id, ['B0', 'B1', 'B2', 'D'][CAST((l_linenumber - 1) % 4 + 1 AS INT)] AS arm, l_returnflag <> 'R' AS fine, l_quantity / 50 AS score
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
      w AS (SELECT case_id FROM s WHERE fine GROUP BY case_id HAVING count(DISTINCT arm) = 4), c AS (SELECT * FROM s WHERE fine AND case_id IN (SELECT case_id FROM w)),
      m AS (SELECT arm, avg(m) AS mean FROM (SELECT arm, owner_id, avg(m) AS m FROM (SELECT arm, owner_id, session_id, avg(score) AS m FROM c WHERE arm <> 'D' GROUP BY arm, owner_id, session_id) GROUP BY arm, owner_id) GROUP BY arm),
      b AS (SELECT arm AS baseline FROM m ORDER BY mean DESC, arm LIMIT 1)
      SELECT case_id, owner_id, session_id, baseline, round(avg(score) FILTER (WHERE arm = 'D') - avg(score) FILTER (WHERE arm = baseline), 6) AS difference FROM c CROSS JOIN b GROUP BY case_id, owner_id, session_id, baseline""",
    "eval_split_windows": """WITH s AS (SELECT o_custkey AS owner_id, o_orderdate AS t, CASE WHEN o_custkey % 7 = 5 AND o_orderkey % 3 = 0 THEN 1 WHEN o_orderdate < '1996-01-01' THEN 1 WHEN o_orderdate < '1997-06-01' OR o_custkey % 7 = 3 THEN 2 ELSE 3 END AS k FROM orders),
      w AS (SELECT owner_id, k, min(t) AS a, max(t) AS b FROM s GROUP BY owner_id, k), n AS (SELECT *, lead(a) OVER (PARTITION BY owner_id ORDER BY k) AS next FROM w) SELECT DISTINCT owner_id FROM n WHERE next <= b""",
    "eval_weighted_gate": """WITH g AS (SELECT l_suppkey AS task, l_linenumber % 5 AS k, sum(l_quantity) / 100 AS mean FROM lineitem GROUP BY l_suppkey, l_linenumber % 5),
      t AS (SELECT task, round(sum(mean * [0.30, 0.25, 0.20, 0.15, 0.10]::DOUBLE[][k + 1]), 6) AS total, round(min(mean), 6) AS least, count(*) AS n_dims FROM g GROUP BY task) SELECT *, total >= 28.0 AND least >= 20.0 AND n_dims = 5 AS passed FROM t""",
    "eval_quality_gate": "WITH g AS (SELECT source, round(avg(quality * 100.0), 4) AS overall, bool_and(toxic = 0) AS all_safe, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source) SELECT *, overall >= 80 AND all_safe AS passed FROM g",
    "eval_review_sample": """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS place FROM documents) WHERE place <= 12
      UNION SELECT d.doc_id, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1""",
}
SQL["eval_weighted_gate"] = SQL["eval_weighted_gate"].replace("::DOUBLE[][k + 1]", "[CAST(k AS INT) + 1]::DOUBLE")
QUERIES = [f for n, f in list(globals().items()) if n.startswith("eval_")]
