"""Queries on figures in texts, with SQL that knows the facts from the columns the texts are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import figures as A
from tessera.sources import notices as N


def text_number_roles(spark, d):
    found = A.number_roles(N.notices(spark, d), ["run"], "excerpt")
    return found.select("run", "at", F.col("value").cast("long").alias("value"), F.array_join("roles", ",").alias("roles"))


def evid_claim_check(spark, d):
    found = A.check_figures(N.claims(spark, d), N.notices(spark, d), N.conditions(spark, d))
    return found.withColumn("value", F.col("value").cast("long"))


def conv_admission_slots(spark, d):
    return A.admission_slots(N.questions(spark, d))


SQL = {
    "text_number_roles": f"""WITH {N.FACTS}, rows AS (SELECT *, 1 + row_number() OVER (PARTITION BY run ORDER BY l_linenumber, concat_ws('|', school, score, rank, places)) AS line FROM facts)
      SELECT DISTINCT run, CAST(0 AS INT) AS "at", year AS value, '' AS roles FROM rows UNION ALL SELECT run, CAST(line AS INT), score, 'SCORE' FROM rows UNION ALL SELECT run, CAST(line AS INT), rank, 'RANK' FROM rows UNION ALL SELECT run, CAST(line AS INT), places, 'COUNT' FROM rows""",
    "evid_claim_check": f"""WITH {N.FACTS}, f AS (SELECT DISTINCT *, l_linenumber % 3 <> 0 AS dated, l_linenumber = 7 AS elsewhere, score + CAST(l_returnflag = 'R' AS INT) AS said,
        run % 7 <> 0 AND run % 11 <> 0 AS agrees, run % 5 <> 0 AS same_year FROM (SELECT DISTINCT * EXCLUDE (places) FROM facts) WHERE run % 13 <> 0),
      s AS (SELECT claim_id, 0 AS sentence, said AS value, elsewhere, agrees AND (same_year OR dated) AND EXISTS (SELECT 1 FROM facts x WHERE x.run = f.run AND x.school = f.school AND x.score = f.said) AS ok FROM f
        UNION ALL SELECT claim_id, 0, rank, elsewhere, agrees AND (same_year OR dated) AS ok FROM f
        UNION ALL SELECT claim_id, 0, year, elsewhere, agrees AS ok FROM f WHERE dated
        UNION ALL SELECT claim_id, 2, guess, false, agrees AND same_year AND EXISTS (SELECT 1 FROM facts x WHERE x.run = f.run AND x.score = f.guess) FROM f WHERE l_linestatus <> 'F')
      SELECT claim_id, sentence, CAST(value AS BIGINT) AS value, CASE WHEN elsewhere THEN 'SCHOOL' WHEN ok THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM s""",
    "conv_admission_slots": f"""WITH {N.QUESTIONS}, r AS (SELECT conversation_id, max(sequence) FILTER (WHERE anew) AS since, arg_max(anew, sequence) AS last_anew FROM questions GROUP BY conversation_id),
      q AS (SELECT q.* FROM questions q JOIN r ON r.conversation_id = q.conversation_id WHERE sequence >= coalesce(since, sequence) AND NOT last_anew),
      p AS (SELECT conversation_id, arg_max(place, sequence) AS place, max(sequence) AS said FROM q WHERE kind = 0 GROUP BY conversation_id),
      k AS (SELECT p.conversation_id, place FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.conversation_id = p.conversation_id AND q.kind = 3 AND q.place = p.place AND q.sequence > p.said)),
      w AS (SELECT q.conversation_id, any_value(k.place) AS province, arg_max(year, sequence) FILTER (WHERE kind = 1) AS year, arg_max(CASE WHEN even THEN '物理' ELSE '历史' END, sequence) FILTER (WHERE kind = 1) AS subjects,
          arg_max(score, sequence) FILTER (WHERE kind = 2) AS score, arg_max(rank, sequence) FILTER (WHERE kind = 4) AS rank, arg_max(CASE WHEN even THEN '本科' ELSE '专科' END, sequence) FILTER (WHERE kind = 4) AS batch, bool_or(kind = 0) AS asks
        FROM q LEFT JOIN k ON k.conversation_id = q.conversation_id GROUP BY q.conversation_id)
      SELECT conversation_id, province, year, subjects, score, rank, batch,
        concat_ws(',', CASE WHEN province IS NULL THEN 'province' END, CASE WHEN year IS NULL THEN 'year' END, CASE WHEN subjects IS NULL THEN 'subjects' END, CASE WHEN score IS NULL THEN 'score' END, CASE WHEN rank IS NULL THEN 'rank' END, CASE WHEN batch IS NULL THEN 'batch' END) AS missing
      FROM w WHERE asks""",
}
QUERIES = [f for n, f in list(globals().items()) if n.startswith(("conv_", "evid_", "text_"))]
