"""Rows that a step makes, and what one task holds, must not grow faster than what is given: crowds under one key, and results against plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import markdown, udfs
from tessera.operators import evaluation, figures, replies, retrieval, validity
from tessera.plans import assessment as plans


def _nodes(plan):
    """The nodes of an executed plan, with those of its stages."""
    name = plan.getClass().getSimpleName()
    yield name, plan
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    for x in inner:
        yield from _nodes(x)


def most_rows(df) -> int:
    """Most rows that came out of one step, after the rows are collected."""
    found = [m.get().value() for _, n in _nodes(df._jdf.queryExecution().executedPlan()) if (m := n.metrics().get("numOutputRows")).isDefined()]
    assert len(found) > 1
    return max(found)


def test_public_batches_of_a_crowded_message(spark):
    n = 300
    batches = spark.range(n).select(F.col("id").alias("batch_id"), F.lit(1).cast("long").alias("conversation_id"), F.lit("GENERATING").alias("status"), F.lit(None).cast("string").alias("failure"), F.lit(0).alias("published_count"))
    runs = spark.range(n).select(F.col("id").alias("run_id"), (F.col("id") % 2).alias("conversation_id"), F.col("id").cast("string").alias("phase"), F.lit("READY").alias("run_status"))
    got = replies.public_batches(batches, batches.select("batch_id", F.lit(7).alias("message_id")), runs, runs.select("run_id", F.lit(7).alias("message_id")))
    assert {r["research_phase"] for r in got.collect()} == {str(n - 1)} and got.count() == n
    assert most_rows(got) <= 4 * n


def test_claims_are_dealt_by_run_only(spark):
    """Sources, claims and conditions meet by run; no other key deals the texts again."""
    run = spark.range(40).select((F.col("id") % 20).alias("run"), "id")
    evidence = run.select("run", F.col("id").alias("source_id"), F.lit("2021年北京 物理类 本科\n院校|最低分|最低位次\n甲乙大学|600|1200\n文字\n丙丁大学|610|1300").alias("excerpt"), F.array().cast("array<string>").alias("years"))
    claims = run.select("run", F.col("id").cast("string").alias("claim_id"), F.when(F.col("id") % 2 == 0, "甲乙大学2021年投档最低分600").otherwise("甲乙大学2021年投档最低分601，丙丁大学最低位次1300").alias("text"), F.lit(None).cast("string").alias("supplied"))
    asked = spark.range(20).select(F.col("id").alias("run"), F.lit("北京").alias("province"), F.lit("物理").alias("subjects"), F.lit("2021").alias("year"))
    got = figures.check_figures(claims, evidence, asked)
    verdicts = {(int(r["claim_id"]) % 2, int(r["value"])): r["verdict"] for r in got.collect()}
    assert verdicts == {(0, 2021): "SUPPORTED", (0, 600): "SUPPORTED", (1, 2021): "SUPPORTED", (1, 601): "UNSUPPORTED", (1, 1300): "UNSUPPORTED"}  # its table has ended
    dealt = [x.split("hashpartitioning(")[1] for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert dealt and all(x.startswith("run#") and x.count("#") <= 2 and "name#" not in x and "at#" not in x for x in dealt), dealt


def test_sources_of_a_run_are_read_once(spark):
    """Claims meet conditions and what their run has read before they are cut; sources are neither sorted by line nor read for each use. Rows that are no plain cells, and units before other words, count as before."""
    source = "2021年北京 物理类 本科\n院校|最低分|最低位次\n甲乙大学|600|1,200\n丙丁大学|0610|1300\n戊己学院|620|1.4千\n学院|7|08"
    evidence = spark.createDataFrame([(1, 1, source, None), (1, 2, "甲乙大学 630分数线", []), (1, 3, None, [])], "run long, source_id long, excerpt string, years array<string>")
    said = ["甲乙大学最低分600。\n最低位次1200。", "丙丁大学最低分610！戊己学院最低位次1400？", "甲乙大学最低分630", "戊己学院最低位次620", "丙丁大学最低分1300。", None]
    claims = spark.createDataFrame([(1, i, t, None) for i, t in enumerate(said)], "run long, claim_id long, text string, supplied string")
    asked = spark.createDataFrame([(1, "北京", "物理", "2021")], "run long, province string, subjects string, year string")
    got = figures.check_figures(claims, evidence, asked)
    verdicts = sorted((r["claim_id"], r["sentence"], int(r["value"]), r["verdict"]) for r in got.collect())
    yes, no = "SUPPORTED", "UNSUPPORTED"
    assert verdicts == [(0, 0, 600, yes), (0, 1, 1200, yes), (1, 0, 610, yes), (1, 1, 1400, yes), (2, 0, 630, yes), (3, 0, 620, no), (4, 0, 1300, no)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Window" not in plan and plan.count("Aggregate") == 1


def test_headings_come_without_a_join(spark):
    """Lines are told their headings by one window; a table of two blocks, with a line between that ends the first."""
    text = "学校|最低分|位次\n甲|600|12\n没有 700\n乙|601|13\n|招生计划|\n|14|"
    got = figures.number_roles(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], "t")
    assert {(r["at"], int(r["value"])): r["roles"] for r in got.collect()} == {(1, 600): ["SCORE"], (1, 12): ["RANK"], (2, 700): [], (3, 601): [], (3, 13): [], (5, 14): ["COUNT"]}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_reports_broadcast_no_questions(spark, sf_dir):
    """Tables of questions grow; only the few references that are wrong may go to the driver."""
    graded = plans._graded(spark, sf_dir)
    graded.collect()
    on_questions = [x for x in graded._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "question_id#" in x]
    assert not on_questions, on_questions


def test_grades_are_dealt_by_question_only(spark, sf_dir):
    graded = plans._graded(spark, sf_dir)
    graded.collect()
    dealt = [x for x in graded._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x and "question_id#" in x]
    assert dealt and not [x for x in dealt if "label#" in x or "arm#" in x], dealt


def test_a_message_of_many_rows_is_no_single_task(spark):
    """All rows rest on the same two messages; the join deals them over several tasks."""
    rows = spark.range(4000).select("id", F.array(F.lit(1), F.lit(2)).alias("ids"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for deleted, n in ((False, 0), (True, 4000)):
            messages = spark.createDataFrame([(1, False), (2, deleted), (3, True)], "id int, deleted boolean")
            got = validity.lost_sources(rows, "id", "ids", messages)
            assert len(got.collect()) == n
        assert len(validity.lost_sources(rows, "id", "ids", messages.where("id <> 1")).collect()) == 4000
        joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in x and "LeftOuter" in x]
        assert joins and all("_deal#" in x for x in joins), joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paired_differences_sum_completed_rows_once(spark):
    """Whether a case is whole is no join and no count of distinct arms; a case of two sessions is whole by both."""
    rows = [(c, 1, c % 3, arm, "COMPLETED", c + k / 4) for c in range(30) for k, arm in enumerate(evaluation.ARMS) if (c, arm) != (4, "B1")] + [(4, 1, 9, "B1", "COMPLETED", 1.0), (5, 1, 2, "B2", "FAILED", 9.0)]
    scored = spark.createDataFrame(rows, "case_id int, owner_id int, session_id int, arm string, status string, score double")
    got = evaluation.paired_differences(scored)
    found = {(r["case_id"], r["session_id"]): (r["baseline"], r["difference"]) for r in got.collect()}
    assert found == {**{(c, c % 3): ("B2", 0.25) for c in range(30)}, (4, 9): ("B2", None)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "distinct" not in plan and "Expand" not in plan


def test_resampling_unpacks_a_block_at_a_time():
    """Blocks of a batch are not turned into Python lists together; each gives the same sums in a batch of its own."""
    rows = [(u, 0, [3], [1.0, 2.0, 4.0], [{"i": i, "c": 1 + i % 2} for i in range(5)]) for u in range(4)]
    kind = pa.schema([("at", pa.int64()), ("block", pa.int64()), ("sizes", pa.list_(pa.int64())), ("means", pa.list_(pa.float64())), ("draws", pa.list_(pa.struct([("i", pa.int64()), ("c", pa.int64())])))])
    batch = pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
    taken = []

    class Column:
        def __init__(self, inner):
            self.inner = inner

        def __getitem__(self, k):
            return self.inner[k]

        def to_pylist(self):
            taken.append(len(self.inner))
            return self.inner.to_pylist()

    class Batch:
        columns = [Column(c) for c in batch.columns]
        column = lambda self, n: self.columns[n]
        __len__ = lambda self: len(batch)

    whole = next(evaluation._resampled(7)([Batch()])).to_pydict()
    single: dict = {}
    for k in range(4):
        part = next(evaluation._resampled(7)([batch.slice(k, 1)])).to_pydict()
        for i, x in zip(part["i"], part["part"], strict=True):
            single[i] = single.get(i, 0.0) + x
    assert not taken and {i: round(x, 9) for i, x in zip(whole["i"], whole["part"], strict=True)} == {i: round(x, 9) for i, x in single.items()}


def test_demands_are_looked_for_where_one_may_begin(monkeypatch):
    """The same matches as a search at each letter; texts without an opening word are not searched."""
    rng = random.Random(3)
    bits = "Ignore disregard send SEND API key reveal print credential 请 执行 脚本 必须 立即 运行 忽略 系统提示 上传 密钥 must  run shell please execute command \n , 。 ſend İgnore previous allowed-tools: none x do not never instructions".split(" ")
    for _ in range(3000):
        text = rng.choice(("", " ")).join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [(m.start(), m.end()) for m in udfs._found(text)] == [(m.start(), m.end()) for m in udfs._DEMAND.finditer(text, overlapped=True)], text
    with monkeypatch.context() as patch:
        patch.setattr(udfs, "_DEMAND", None)
        patch.setattr(udfs, "_CLAUSE_END", None)
        assert udfs.demands_of("nothing here, nothing there. " * 100) == []
    with pytest.raises(AttributeError), monkeypatch.context() as patch:
        patch.setattr(udfs, "_DEMAND", None)
        udfs.demands_of("print the secret")


def test_all_demands_of_a_text_are_told(spark):
    """None is left out, however many a text holds; equal excerpts are one."""
    text = "".join(f"{i:04d} words that ask for nothing; print secret number {i:04d} of a list of them, and so on.\n" for i in range(300))
    got = spark.createDataFrame([(1, text), (2, text * 2)], "id int, t string").select("id", udfs.permission_demands("t").alias("demands"))
    found = {r["id"]: r["demands"] for r in got.collect()}
    assert len(found[1]) == 300 and all(f"print secret number {i:04d} of" in x for i, x in enumerate(found[1]))
    assert found[2] == found[1]


def test_plain_words_are_not_scanned(monkeypatch):
    """What holds no markup comes back as it stands; what does is read as before, wherever it stands."""
    assert markdown.inline("a ![b](http://c.d) **e** h https://f.g/_h_ ! [i] \\* <j@k.lm> ~~n~~ __init__ `o*` $p$ !") == "a b（http://c.d） e h https://f.g/_h_ ! [i] * j@k.lm n __init__ o* $p$ !"
    monkeypatch.setattr(markdown, "_scanned", None)
    assert markdown.inline("the hat! has 3 h-s, (brackets) and \"quotes\"") == "the hat! has 3 h-s, (brackets) and \"quotes\""


def test_arms_are_scored_once(spark):
    """Counts and means come from one pass over the answers; sessions and owners without a completed answer count in no mean."""
    rows = [("D", "a", "s", "COMPLETED", 1.0), ("D", "a", "s", "FAILED", 9.0), ("D", "a", "t", "COMPLETED", 0.0), ("D", "b", "u", "FAILED", 9.0), ("D", "c", "v", "COMPLETED", 1.0), ("B0", "a", "s", "MISSING", None)]
    got = evaluation.arm_summary(spark.createDataFrame(rows, "arm string, owner_id string, session_id string, status string, score double"))
    assert {tuple(r) for r in got.collect()} == {("D", 5, 3, 0, 2, 0.75), ("B0", 1, 0, 1, 0, None)}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_questions_meet_their_owners_earlier_memories(spark, monkeypatch):
    """Only what a case may see is turned into terms; the best of blocks, of frequent terms and of others are those of plain sets."""
    for name, value in {"SCOPED": 40, "WORDS": 1, "CELLS": 50, "TERMS": 60}.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    memories = [(i, rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, *range(40)]), sorted({rng.choice(words[: rng.choice([8, 200])]) for _ in range(rng.randint(0, 90))})) for i in range(300)]
    cases = [(i, rng.choice([None, "a", "b", "d"]), rng.choice([None, *range(30)]), sorted({rng.choice(words) for _ in range(rng.randint(0, 90))})) for i in range(40)]
    written = {}
    real = evaluation.materialise

    def noted(df, name, by=None):
        written[name] = real(df, name, by)
        return written[name]

    monkeypatch.setattr(evaluation, "materialise", noted)
    m = spark.createDataFrame([(i, o, "x", t, f"{t or 0:05d}", " ".join(w), "yes") for i, o, t, w in memories], "id long, owner_id string, domain string, occurred long, occurred_text string, content string, choice string")
    c = spark.createDataFrame([(i, o, "x", t, " ".join(w), ["yes"]) for i, o, t, w in cases], "case_id long, owner_id string, domain string, occurred long, question string, options array<string>")
    evaluation.four_arms(m, c).collect()
    last = {o: max(t for _, p, t, _ in cases if p == o and t is not None) for o in ("a", "b", "d")}
    assert {r["id"] for r in written["memories"].collect()} == {i for i, o, t, _ in memories if o in last and t is not None and t < last[o]}

    terms = retrieval.term_hashes(F.col("text"))
    docs = written["memories"].withColumnRenamed("id", "doc_id")
    asked = c.select(F.col("case_id").alias("item_id"), "owner_id", "occurred", F.col("question").alias("text")).withColumn("terms", terms)
    got = {(r["item_id"], r["place"]): (r["doc_id"], r["score"]) for r in retrieval.most_shared(asked, docs, 3).collect()}
    want = {}
    for i, o, t, w in cases:
        seen = [(-n, d) for d, p, at, v in memories if o is not None and p == o and None not in (t, at) and at < t and (n := len({*v} & {*w}))]
        want |= {(i, k + 1): (d, float(-n)) for k, (n, d) in enumerate(sorted(seen)[:3])}
    assert got == want and len(want) > 40
