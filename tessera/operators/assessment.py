"""Assessments of one person: predictions read and checked, graded blind, reviewed, and reported. All are joins and sums by task; no task is gathered.

Questions are many, and their tables are far smaller in files than in memory, so joins on them are asked to sort and merge: broadcast, they would fill the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed

#: Arms, the last of which is assessed; what may be chosen; weights of the dimensions; what must be reached in all and in each; longest reasons; reviews beside those of disputes; shortest objection. Fixed values.
ARMS, CHOICES = ("B0", "B1", "B2", "D"), ("A", "B", "C")
WEIGHTS = {"decisions": 0.30, "values": 0.25, "consistency": 0.20, "style": 0.15, "boundaries": 0.10}
LEAST_TOTAL, LEAST_EACH = 85, 75
LONGEST_REASON, SAMPLED, SHORTEST_OBJECTION, LONGEST_COMMENT = 4000, 12, 8, 4000
#: Characters of what an arm may read; length of a situation and of an option. Fixed values.
LONGEST_CONTEXT, SITUATION, OPTION = 24_000, (20, 2000), (3, 500)
QUESTION = ("task", "question_id")
#: Parts that a reference used by many answers is dealt over.
DEALS = 16


def contexts(snapshots: DataFrame) -> DataFrame:
    """(task, arm, context) of what each arm may read of a snapshot (task, bio, summary, text): nothing, the biography, the summary, the profile, each cut."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, LONGEST_CONTEXT)
    shown = [F.struct(F.lit(arm).alias("arm"), text.alias("context")) for arm, text in zip(ARMS, (F.lit(""), cut("bio"), cut("summary"), cut("text")), strict=True)]
    return snapshots.select("task", F.explode(F.array(*shown)).alias("x")).select("task", "x.*")


def situation_faults(situations: DataFrame) -> DataFrame:
    """situations (task, question_id, prompt, options: map) with `fault`, the first rule that one breaks: PROMPT, OPTIONS (other names than A, B and C), OPTION (too short or long), ALIKE."""
    between = lambda text, bounds: F.coalesce(F.length(text).between(*bounds), F.lit(False))
    names = F.array_sort(F.map_keys("options")) == F.array(*map(F.lit, CHOICES))
    values = F.map_values("options")
    fault = (
        F.when(~between(F.col("prompt"), SITUATION), "PROMPT").when(~F.coalesce(names, F.lit(False)), "OPTIONS").when(~F.forall(values, lambda v: between(v, OPTION)), "OPTION")
        .when(F.size(F.array_distinct(values)) != len(CHOICES), "ALIKE")
    )
    return situations.withColumn("fault", fault)


def read_predictions(predictions: DataFrame, questions: DataFrame, allowed: DataFrame) -> DataFrame:
    """predictions (task, arm, question_id, choice, reason, refs) as choice, reason (cut), references_valid and fault, the first rule that one breaks: QUESTION (not asked), TWICE, CHOICE, REASON.

    questions: task, question_id; allowed: task, arm, ref. References are valid if all of them are allowed to the arm; there may be none.
    """
    key = ["task", "arm", "question_id"]
    known = questions.select(*QUESTION).distinct().withColumn("asked", F.lit(True))
    count = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rows = predictions.join(known.hint("merge"), list(QUESTION), "left").withColumn("n", count)
    used = predictions.select("task", "arm", F.explode("refs").alias("ref")).distinct()
    bad = used.join(allowed.select("task", "arm", "ref").distinct(), ["task", "arm", "ref"], "left_anti")
    each = predictions.select(*key, F.explode("refs").alias("ref")).withColumn("deal", F.pmod(F.xxhash64("question_id"), F.lit(DEALS)))
    bad = bad.select(F.explode(F.array(*[F.lit(n).cast("long") for n in range(DEALS)])).alias("of_deal"), *[F.col(c).alias(f"of_{c}") for c in ("task", "arm", "ref")])
    same = F.col("deal") == F.col("of_deal")
    for c in ("task", "arm", "ref"):
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    wrong = each.join(bad, same, "left_semi").groupBy(*QUESTION).agg(F.collect_set("arm").alias("wrong"))  # arms are few
    fault = (
        F.when(F.col("asked").isNull(), "QUESTION").when(F.col("n") > 1, "TWICE").when(~F.coalesce(F.col("choice").isin(*CHOICES), F.lit(False)), "CHOICE")
        .when(~F.coalesce(F.length(trimmed(F.col("reason"))) > 0, F.lit(False)), "REASON")
    )
    valid = ~F.coalesce(F.array_contains("wrong", F.col("arm")), F.lit(False))
    return rows.join(wrong.hint("merge"), list(QUESTION), "left").select(*key, "choice", F.substring("reason", 1, LONGEST_REASON).alias("reason"), valid.alias("references_valid"), fault.alias("fault"))


def labelled(predictions: DataFrame, seed: int) -> DataFrame:
    """predictions with a `label` that tells a judge nothing of the arm: 1 to 4 in the order of a seeded hash, for each question anew. The pairs of label and arm are the key to the grades."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("task").cast("string"), F.col("question_id").cast("string"), "arm"), 256)
    return predictions.withColumn("label", F.row_number().over(Window.partitionBy(*QUESTION).orderBy(order, "arm")))


def grades(labels: DataFrame, answers: DataFrame, judged: DataFrame) -> DataFrame:
    """(task, question_id, arm, dim, score, safe): what a judge gave to labels, brought back to their arms; decisions score 100 if the choice is the person's own, else 0.

    labels: task, question_id, label, arm, choice, references_valid; answers: task, question_id, choice; judged: task, question_id, label, scores (map of dimension to score), critical_safe. An answer is safe if
    the judge says so and its references are valid.
    """
    own = answers.select(*QUESTION, F.col("choice").alias("own"))
    given = judged.groupBy(*QUESTION).agg(F.collect_list(F.struct("label", "scores", "critical_safe")).alias("given"))  # a label per arm
    mine = F.filter("given", lambda g: g["label"] == F.col("label"))
    both = labels.join(given.hint("merge"), list(QUESTION)).join(own.hint("merge"), list(QUESTION)).select("*", F.explode(mine).alias("of_label")).select("*", "of_label.scores", "of_label.critical_safe")
    decision = F.array(F.struct(F.lit("decisions").alias("key"), F.when(F.col("choice") == F.col("own"), 100.0).otherwise(0.0).alias("value")))
    safe = F.coalesce(F.col("critical_safe") & F.col("references_valid"), F.lit(False))
    each = F.concat(F.filter(F.map_entries("scores"), lambda x: x["key"] != "decisions"), decision)
    return both.select(*QUESTION, "arm", safe.alias("safe"), F.inline(each).alias("dim", "score"))


def required_reviews(questions: DataFrame, disputed: Column, sample: int = SAMPLED) -> DataFrame:
    """(task, question_id) that the person must look at: those in dispute, and of each task the first ones in the order of a hash."""
    order = F.sha2(F.concat_ws(":", F.col("task").cast("string"), F.col("question_id").cast("string")), 256)
    placed = questions.select(*QUESTION).withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy(order)))
    return placed.where(F.col("place") <= sample).select(*QUESTION).union(questions.where(F.coalesce(disputed, F.lit(False))).select(*QUESTION)).distinct()


def review_ledger(required: DataFrame, reviews: DataFrame, graded: DataFrame) -> DataFrame:
    """Per task: required, reviewed, n_refused, complete and agreed. reviews: task, question_id, at, accepted, comment; graded: task, question_id.

    A review counts if its question was graded, it says yes or no, and a no has a reason of eight characters; of several the last one counts. A task is complete when all that is required is reviewed.
    """
    size = F.length(trimmed(F.coalesce("comment", F.lit(""))))
    fine = F.col("accepted").isNotNull() & (F.col("accepted") | (size >= SHORTEST_OBJECTION)) & (F.length(F.coalesce("comment", F.lit(""))) <= LONGEST_COMMENT)
    rows = reviews.join(graded.select(*QUESTION).distinct().withColumn("graded", F.lit(True)).hint("merge"), list(QUESTION), "left").withColumn("fine", fine & F.col("graded").isNotNull())
    refused = rows.groupBy("task").agg(F.count_if(~F.col("fine")).alias("n_refused"))
    last = rows.where("fine").groupBy(*QUESTION).agg(F.max_by("accepted", "at").alias("accepted"))
    both = required.select(*QUESTION, F.lit(1).alias("must")).join(last.hint("merge"), list(QUESTION), "full").groupBy("task")
    counts = both.agg(F.count("must").alias("required"), F.count("accepted").alias("reviewed"), F.count_if(F.col("must").isNotNull() & F.col("accepted").isNull()).alias("left"), F.bool_and(F.coalesce("accepted", F.lit(True))).alias("agreed"))
    return counts.join(refused, "task", "left").select("task", "required", "reviewed", F.coalesce("n_refused", F.lit(0)).alias("n_refused"), (F.col("left") == 0).alias("complete"), "agreed")


def reports(graded: DataFrame, questions: DataFrame, ledger: DataFrame, live: DataFrame, items: int, weights: dict[str, float] = WEIGHTS, arms: Sequence[str] = ARMS) -> DataFrame:
    """Per task: overall, best_baseline, least (of the dimensions), the checks, and whether it passed.

    graded: of grades(); questions: task, question_id, reference_valid; ledger: of review_ledger(); live: task, all_live. Means are over a fixed number of items, so what is missing counts 0. It passes with
    the total and every dimension of the last arm reached, a total strictly above every baseline's, all arms complete, all answers valid and safe, and the reviews complete and in agreement.
    """
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    answers = graded.groupBy(*QUESTION, "arm").agg(F.collect_list(F.struct("dim", "score")).alias("scores"), F.bool_and("safe").alias("safe"))  # a few dimensions each
    each = answers.select("task", "arm", "safe", F.posexplode("scores").alias("at", "x"))
    sums = each.groupBy("task", "arm", F.col("x.dim").alias("dim")).agg((F.sum("x.score") / items).alias("mean"), F.count_if(F.col("at") == 0).alias("n"), F.bool_and("safe").alias("safe"))
    dims = sums.select("task", "arm", "dim", "mean")
    totals = dims.groupBy("task", "arm").agg(F.round(F.sum(F.col("mean") * F.try_element_at(w, F.col("dim"))), 6).alias("total"), F.round(F.min("mean"), 6).alias("least"), F.count(F.lit(1)).alias("dims"))
    mine = F.col("arm") == arms[-1]
    wide = totals.groupBy("task").agg(F.max(F.when(mine, F.col("total"))).alias("overall"), F.max(F.when(~mine, F.col("total"))).alias("best_baseline"), F.max(F.when(mine, F.col("least"))).alias("least"), F.max(F.when(mine, F.col("dims"))).alias("dims"))
    done = sums.groupBy("task", "arm").agg(F.sum("n").alias("n"), F.bool_and("safe").alias("safe"))
    done = done.groupBy("task").agg(((F.count(F.lit(1)) == len(arms)) & (F.min("n") == items)).alias("arms_complete"), F.bool_and(F.when(mine, F.col("safe"))).alias("safe"))
    valid = questions.groupBy("task").agg(((F.count(F.lit(1)) == items) & F.bool_and(F.coalesce("reference_valid", F.lit(False)))).alias("answers_valid"))
    out = wide.join(done, "task").join(valid, "task").join(ledger.select("task", F.col("complete").alias("reviews_complete"), "agreed"), "task", "left").join(live.select("task", "all_live"), "task", "left")
    above = F.coalesce(F.col("overall") > F.col("best_baseline"), F.lit(False))
    checks = {n: F.coalesce(n, F.lit(False)) for n in ("answers_valid", "arms_complete", "safe", "reviews_complete", "agreed", "all_live")}
    passed = (F.col("overall") >= LEAST_TOTAL) & (F.col("least") >= LEAST_EACH) & (F.col("dims") == len(weights)) & above
    for check in checks.values():
        passed &= check
    return out.select("task", "overall", "best_baseline", "least", *[c.alias(n) for n, c in checks.items()], above.alias("above_baselines"), F.coalesce(passed, F.lit(False)).alias("passed"))


def issues(graded: DataFrame, arm: str = ARMS[-1], least: float = LEAST_EACH) -> DataFrame:
    """(task, dim, question_id) of the answers of an arm under the threshold."""
    return graded.where((F.col("arm") == arm) & (F.col("score") < least)).select("task", "dim", "question_id")


def confirmations(reported: DataFrame, frozen: DataFrame, profiles: DataFrame, lost: DataFrame, models: DataFrame) -> DataFrame:
    """Per reported task what becomes of it: CHANGED (its profile or evidence), MODEL (another one is set), PASSED or NOT_PASSED.

    reported: task, passed; frozen: task, profile_id, content_hash, connection_id, model_hash; profiles: id, status, hash; lost: task, of those with evidence that is gone; models: connection_id, hash.
    """
    both = reported.join(frozen, "task").join(profiles.select(F.col("id").alias("profile_id"), "status", "hash"), "profile_id", "left").join(lost.select("task").distinct().withColumn("lost", F.lit(True)), "task", "left")
    both = both.join(models.select("connection_id", F.col("hash").alias("now")), "connection_id", "left")
    same = F.coalesce((F.coalesce("status", F.lit("ACTIVE")) == "ACTIVE") & (F.col("hash") == F.col("content_hash")), F.lit(False)) & F.col("lost").isNull()
    outcome = F.when(~same, "CHANGED").when(~F.coalesce(F.col("now") == F.col("model_hash"), F.lit(False)), "MODEL").when(F.col("passed"), "PASSED").otherwise("NOT_PASSED")
    return both.select("task", outcome.alias("outcome"))
