"""Paired evaluation: arms, scores, clustered means, bootstrap, gates, validators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import most_shared, term_hashes
from tessera.scans import running
from tessera.shared import materialise, spread
from tessera.sources.tables import REAL_ORIGINS

ARMS = ("B0", "B1", "B2", "D")
EVALUATION_ORIGINS = REAL_ORIGINS[:3]


def clustered_mean(rows: DataFrame, user: str, session: str, value: str) -> DataFrame:
    """Mean of items per session, of sessions per user, of users: one row."""
    sessions = rows.groupBy(user, session).agg(F.avg(value).alias("m"))
    return sessions.groupBy(user).agg(F.avg("m").alias("m")).agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("n_users"))


_ENTRY = "struct<text:string,id:long>"


def _events(memories: DataFrame, cases: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Memories (kind 1, with `values`) and cases (kind 0, without) in one table; at equal times cases come first, so what runs up to a case is strictly before it."""
    none = F.lit(None)
    asked = cases.select(*by, "occurred", F.lit(0).alias("kind"), "case_id", *[none.cast(_ENTRY).alias(n) for n in values])
    return asked.unionByName(memories.select(*by, "occurred", F.lit(1).alias("kind"), none.cast(cases.schema["case_id"].dataType).alias("case_id"), *[v.cast(_ENTRY).alias(n) for n, v in values.items()]))


_IN_TIME = ("occurred", "kind")


def four_arms(memories: DataFrame, cases: DataFrame, top: int = 2) -> DataFrame:
    """(arm, case_id, choice, evidence_id) of four predictors: B0 sees nothing, B1 the first memory, B2 the `top` memories that share most terms with the question, D all
    memories of the case's domain. Each takes the latest of what it sees whose choice the case allows, or else says ABSTAIN.

    memories: id, owner_id, domain, occurred, occurred_text, content, choice; cases: case_id, owner_id, domain, occurred, question, options. Only memories of the same owner from strictly
    before the case are seen. No case meets its owner's memories: the first memory and, for each choice, the domain's latest one are running extremes, and B2's come from the
    table of terms, or, where fewer share a term, from the smallest ids, which are running minima too. Texts are read once, into terms, and of those only what a case may see: memories
    of owners who have a case, from before their last one. Without an owner nothing is seen.
    """
    cases = materialise(cases.select("case_id", "owner_id", "domain", "occurred", "options", term_hashes(F.col("question")).alias("terms")), "cases")
    last = materialise(cases.groupBy("owner_id").agg(F.max("occurred").alias("last")), "owners")
    memories = spread(memories)
    memories = memories.join(last, (memories["owner_id"] == last["owner_id"]) & (memories["occurred"] < last["last"]), "left_semi")
    memories = memories.select("id", "owner_id", "domain", "occurred", "occurred_text", "choice", term_hashes(F.col("content")).alias("terms"))
    memories = materialise(memories.sortWithinPartitions("owner_id", "occurred"), "memories")

    at = F.struct(F.col("occurred_text").alias("text"), F.col("id").alias("id"))
    own = F.struct(F.lit("").alias("text"), F.col("id").alias("id"))
    order = [F.col(c).asc() for c in _IN_TIME]
    running_least = running(_events(memories, cases, ["owner_id"], {"entry": at, "own": own}), ["owner_id"], order, {"first": F.col("entry"), "least": F.col("own")}, "min", upto=-1)
    first = running_least.where("kind = 0").select(F.lit("B1").alias("arm"), "case_id", F.col("first.id").alias("id"))

    shared = most_shared(cases.withColumnRenamed("case_id", "item_id"), memories.withColumnRenamed("id", "doc_id"), top).select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("id"), "score")
    seen = shared
    for n in range(top):  # the next smallest id so far is the least of: an id, or what was smallest before it, if that is larger
        seen = seen.unionByName(running_least.where("kind = 0 and least is not null").select("case_id", F.col("least.id").alias("id"), F.lit(0.0).alias("score")))
        if n + 1 < top:
            left = running_least.select("owner_id", "occurred", "kind", "case_id", F.when(F.col("least").isNotNull(), F.greatest("own", "least")).alias("own"))
            left = left.withColumn("own", F.when(F.col("kind") == 1, F.col("own")))
            running_least = running(left, ["owner_id"], order, {"least": F.col("own")}, "min", upto=-1)
    seen = seen.groupBy("case_id", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "id"))
    best = seen.withColumn("place", place).where(F.col("place") <= top).select(F.lit("B2").alias("arm"), "case_id", "id")

    options = cases.select("case_id", "owner_id", "domain", "occurred", F.explode(F.array_distinct("options")).alias("choice"))
    by = ["owner_id", "domain", "choice"]
    latest = running(_events(memories.where("choice is not null"), options, by, {"entry": at}), by, order, {"seen": F.col("entry")}, "max", upto=-1).where("kind = 0 and seen is not null")
    said = first.unionByName(best).where("id is not null").join(memories.select("id", "occurred_text", "choice"), "id").join(cases.select("case_id", "options"), "case_id").where(F.array_contains("options", F.col("choice")))
    said = said.select("arm", "case_id", "choice", F.struct(F.col("occurred_text").alias("text"), "id").alias("x")).unionByName(latest.select(F.lit("D").alias("arm"), "case_id", "choice", F.col("seen").alias("x")))
    chosen = said.groupBy("arm", "case_id").agg(F.max_by("choice", "x").alias("choice"), F.max("x").alias("x"))
    every = cases.select("case_id", F.explode(F.array(*map(F.lit, ARMS))).alias("arm"))
    return every.join(chosen, ["arm", "case_id"], "left").select("arm", "case_id", F.coalesce("choice", F.lit("ABSTAIN")).alias("choice"), F.col("x.id").alias("evidence_id"))


def primary_score(choice: Column, reference: Column, said: Column, rubric: Column) -> Column:
    """Choice match, averaged with the share of rubric phrases that the reasons hold, if there is a rubric."""
    match = (choice == reference).cast("double")
    text = F.lower(F.array_join(said, " "))
    hits = F.size(F.filter(rubric, lambda p: F.contains(text, F.lower(p))))
    return F.when(F.size(rubric) > 0, (match + hits / F.size(rubric)) / 2).otherwise(match)


def arm_summary(scored: DataFrame) -> DataFrame:
    """Per arm: how many cases were expected, completed, missing and failed, and the clustered mean of the completed. scored: arm, owner_id, session_id, status, score.

    Counts and means are taken in one pass, as what is scored may be dear.
    """
    state = lambda s: F.count_if(F.col("status") == s)
    counts = {"expected": F.count(F.lit(1)), "completed": state("COMPLETED"), "missing": state("MISSING"), "failed": state("FAILED")}
    rows = scored.groupBy("arm", "owner_id", "session_id").agg(*[c.alias(n) for n, c in counts.items()], F.avg(F.when(F.col("status") == "COMPLETED", F.col("score"))).alias("m"))
    for by in (["arm", "owner_id"], ["arm"]):
        rows = rows.groupBy(*by).agg(*[F.sum(n).alias(n) for n in counts], F.avg("m").alias("m"))
    return rows.select("arm", *counts, F.round("m", 6).alias("mean"))


def arm_means(scored: DataFrame) -> DataFrame:
    """Per arm the mean of items per session, of sessions per owner, of owners."""
    sessions = scored.groupBy("arm", "owner_id", "session_id").agg(F.avg("score").alias("m"))
    return sessions.groupBy("arm", "owner_id").agg(F.avg("m").alias("m")).groupBy("arm").agg(F.avg("m").alias("mean"))


def complete_cases(scored: DataFrame, arms: tuple[str, ...] = ARMS) -> DataFrame:
    """Per case_id, owner_id and session_id of the cases that every arm completed: of each arm the sum of its scores and how many there are, as `sum_<arm>` and `n_<arm>`.

    Completed rows are summed once; whether a case is whole is seen from the sums of its own rows, so rows dealt by case are not dealt again.
    """
    done = scored.where("status = 'COMPLETED'").where(F.col("arm").isin(*arms))
    mine = lambda a, value: F.when(F.col("arm") == a, value)
    cells = done.groupBy("case_id", "owner_id", "session_id").agg(*[f(mine(a, v)).alias(f"{n}_{a}") for a in arms for n, f, v in (("sum", F.sum, F.col("score")), ("n", F.count, F.col("score")), ("rows", F.count, F.lit(1)))])
    of_case = Window.partitionBy("case_id")
    whole = F.lit(True)
    for a in arms:
        whole &= F.max(f"rows_{a}").over(of_case) > 0
    return cells.withColumn("whole", whole).where(F.col("whole") & F.col("case_id").isNotNull()).drop("whole", *[f"rows_{a}" for a in arms])


def paired_differences(scored: DataFrame, arm: str = "D") -> DataFrame:
    """Per complete case: the arm's score less that of the strongest other arm, which is chosen once, on the complete cases.

    Several answers of an arm to a case count as their mean.
    """
    cells = complete_cases(scored)
    sessions = cells.groupBy("owner_id", "session_id").agg(*[F.sum(f"{n}_{a}").alias(f"{n}_{a}") for a in ARMS if a != arm for n in ("sum", "n")])
    each = F.array(*[F.struct(F.lit(a).alias("arm"), _mean(a).alias("score")) for a in ARMS if a != arm])
    means = arm_means(sessions.select("owner_id", "session_id", F.inline(each)).where("score is not null"))
    best = strongest(means).select(F.col("strongest").alias("baseline"))  # one row
    other = F.coalesce(*[F.when(F.col("baseline") == a, _mean(a)) for a in ARMS])
    return cells.join(F.broadcast(best)).select("case_id", "owner_id", "session_id", "baseline", (_mean(arm) - other).alias("difference"))


def _mean(arm: str) -> Column:
    return F.when(F.col(f"n_{arm}") > 0, F.col(f"sum_{arm}") / F.col(f"n_{arm}"))


def strongest(means: DataFrame, arm: str = "arm", mean: str = "mean") -> DataFrame:
    """The best arm; of equals the first by name."""
    return means.agg(F.min_by(arm, F.struct(-F.col(mean), F.col(arm))).alias("strongest"), F.max(mean).alias("best_mean"))


BLOCK = 20_000  # sessions of a user that are resampled at a time


def _seeded(*parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([p % 2**63 for p in parts])))


def _resampled(seed: int):
    """Of each block of a user's sessions and each iteration, its part of the sum of the user's means."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, float] = {}
        for batch in batches:
            for k in range(len(batch)):  # one block at a time is unpacked
                user, block, draws = (batch.column(c)[k].as_py() for c in (0, 1, 4))
                sizes, means = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                total = int(sizes.sum())
                for draw in draws:
                    # Every block of the user deals the same draws over the blocks, and then takes its own share.
                    share = int(_seeded(seed, user, draw["i"]).multinomial(draw["c"] * total, sizes / total)[block])
                    taken = _seeded(seed, user, draw["i"], block).integers(0, len(means), share)
                    sums[draw["i"]] = sums.get(draw["i"], 0.0) + float(means[taken].sum()) / total
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.float64())], ["i", "part"])

    return of


def bootstrap(rows: DataFrame, seed: int, iterations: int = 1000, user: str = "owner_id", session: str = "session_id", value: str = "difference") -> DataFrame:
    """Resamples users, then sessions of each, a session keeping all its items; the interval by index, null under two users.

    Each iteration draws as many users as there are, by hashes of seed, iteration and slot; a user's sessions are resampled in blocks of about
    `BLOCK`, each with a generator seeded by its place, so the same seed gives the same interval however the work is dealt out. Only the
    sums of the iterations meet. Rows without a user, session or value are left out; without rows all is null.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(user).alias("u"), F.col(session).alias("s"), F.col(value).alias("v")).where("u is not null and s is not null and v is not null")
    means = materialise(known.groupBy("u", "s").agg(F.avg("v").alias("m")), "means")
    users = materialise(means.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean")), "users")
    n_users, estimate, sessions = users.agg(F.count(F.lit(1)), F.avg("mean"), F.sum("n")).first()
    if not n_users:
        return spark.createDataFrame([(None, None, None, 0, 0)], "estimate double, low double, high double, users long, sessions long")
    numbered = _numbered(users)
    slots = spark.range(iterations * n_users).select((F.col("id") / n_users).cast("long").alias("i"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_users)).alias("at"))
    drawn = slots.groupBy("i", "at").agg(F.count(F.lit(1)).alias("c")).groupBy("at").agg(F.collect_list(F.struct("i", "c")).alias("draws"))  # an entry per iteration at most
    blocks = means.join(numbered.select("u", "at", F.ceil(F.col("n") / BLOCK).alias("blocks")), "u").withColumn("block", F.pmod(F.xxhash64("s"), "blocks"))
    blocks = blocks.groupBy("at", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "m"))), lambda x: x["m"]).alias("means"))  # about BLOCK sessions
    order = F.array_sort(F.collect_list(F.struct("block", F.size("means").alias("size"))))
    sizes = blocks.groupBy("at").agg(F.transform(order, lambda x: x["size"]).alias("sizes"), F.transform(order, lambda x: x["block"]).alias("names"))
    work = blocks.join(sizes, "at").join(drawn, "at").select("at", (F.array_position("names", F.col("block")) - 1).alias("block"), "sizes", "means", "draws")
    sums = work.mapInArrow(_resampled(seed), "i long, part double").groupBy("i").agg((F.sum("part") / n_users).alias("x"))
    place = F.row_number().over(Window.orderBy("x")) - 1  # a row per iteration
    low, high = (floor((iterations - 1) * q) for q in (0.025, 0.975))
    ends = sums.withColumn("place", place).agg(*[F.max(F.when((F.col("place") == at) & F.lit(n_users > 1), F.col("x"))).alias(name) for name, at in (("low", low), ("high", high))])
    return ends.select(F.lit(estimate).alias("estimate"), "low", "high", F.lit(n_users).cast("long").alias("users"), F.lit(sessions).cast("long").alias("sessions"))


def _numbered(users: DataFrame) -> DataFrame:
    """users with `at`, 0 to n - 1 in the order of a hash: counted per range of the hash, so that no task has all of them."""
    split = users.withColumn("h", F.xxhash64("u")).withColumn("range", F.shiftrightunsigned("h", 54))
    before = split.groupBy("range").count().select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))  # 1024 rows at most
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "u"))
    return split.withColumn("inside", inside).join(F.broadcast(before), "range").select("u", "n", (F.col("before") + F.col("inside") - 1).alias("at"))


def violations(records: DataFrame) -> DataFrame:
    """(rule, id): every breach in a paired data set; the rules by name, in the order in which they are checked."""
    instant = F.try_to_timestamp(F.when(F.col("occurred_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col("occurred_at")))
    rows = records.withColumn("instant", instant)
    memory, case = F.col("kind") == "memory", F.col("kind") == "case"
    simple = {
        "a_fields": F.col("id").isNull() | F.col("owner_id").isNull() | F.col("session_id").isNull(),
        "b_kind": ~F.coalesce(memory | case, F.lit(False)),
        "c_split": ~F.coalesce(F.col("split").isin("train", "dev", "holdout"), F.lit(False)),
        "d_instant": F.col("instant").isNull(),
        "e_origin": memory & ~F.coalesce(F.col("source_origin").isin(*EVALUATION_ORIGINS), F.lit(False)),
        "f_subject": memory & ~F.coalesce(F.col("subject_id") == F.col("owner_id"), F.lit(False)),
        "g_consent": memory & ~F.coalesce(F.col("consent_purpose") == "PFE_TRAINING", F.lit(False)),
        "h_memory_split": memory & (F.col("split") != "train"),
        "i_case_split": case & (F.col("split") == "train"),
        "j_reference": case & ~F.coalesce((F.col("reference.choice") == "ABSTAIN") | F.array_contains("options", F.col("reference.choice")), F.lit(False)),
        "k_rubric": case & F.col("reference.reasons").isNull(),
    }
    found = rows.select("id", F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in simple.items()]))).alias("rule"))
    twice = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("l_duplicate").alias("rule"))
    crossing = records.groupBy("session_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col("session_id").alias("id"), F.lit("m_session").alias("rule"))
    return found.unionByName(twice).unionByName(crossing).unionByName(overlapping(rows.select("owner_id", "split", F.col("instant").alias("at"))).select(F.col("owner_id").alias("id"), F.lit("n_windows").alias("rule"))).select("rule", "id")


def overlapping(rows: DataFrame, order: tuple[str, ...] = ("train", "dev", "holdout")) -> DataFrame:
    """Owners whose splits overlap in time: the last of one is not before the first of the next that the owner has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("split"))
    windows = rows.groupBy("owner_id", rank.alias("rank")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    after = F.lead("first").over(Window.partitionBy("owner_id").orderBy("rank"))
    return windows.withColumn("next", after).where("next <= last").select("owner_id").distinct()


def weighted_gate(grades: DataFrame, weights: dict[str, float], items: int, total: float, each: float) -> DataFrame:
    """Per task: dimension totals over a fixed number of items, their weighted sum, and whether all thresholds hold. grades: task, dim, score."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    dims = grades.groupBy("task", "dim").agg((F.sum("score") / items).alias("mean"))
    out = dims.groupBy("task").agg(F.round(F.sum(F.col("mean") * F.element_at(w, F.col("dim"))), 6).alias("total"), F.round(F.min("mean"), 6).alias("least"), F.count(F.lit(1)).alias("n_dims"))
    return out.withColumn("passed", (F.col("total") >= total) & (F.col("least") >= each) & (F.col("n_dims") == len(weights)))


def hash_sample(rows: DataFrame, key: Column, group: str, most: int) -> DataFrame:
    """Of each group the first rows in the order of a hash: the same sample each time."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.sha2(key.cast("string"), 256)))
    return rows.withColumn("place", place).where(F.col("place") <= most)
