"""Goals, folds, scans, validity, voices and recall against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import udfs
from tessera.operators import assembly as A
from tessera.operators import changes as C
from tessera.operators import evaluation as E
from tessera.operators import evidence as V
from tessera.operators import folds, goals, voices
from tessera.operators import retrieval as R
from tessera.scans import running


def test_goals_by_revision(spark):
    rng = random.Random(1)
    rows = [(g, p, rng.choice([0, 1, 1, 2, 2, 3, None]), rng.choice(["approve", "revoke"])) for g in range(60) for p in range(rng.randint(0, 9))]
    want = {}
    for g in range(60):
        state, now = "PROPOSED", 1
        for _, p, revision, operation in (r for r in rows if r[0] == g):
            target = {"approve": "APPROVED", "revoke": "REVOKED"}[operation]
            outcome = "REPEATED" if state == target and revision in (now, now - 1) else "CONFLICT" if revision != now else "REVOKED" if state == "REVOKED" else "APPLIED"
            if outcome == "APPLIED":
                state, now = target, now + 1
            want[g, p] = outcome, now
    got = goals.judged_requests(spark.createDataFrame(rows, "goal long, place long, revision long, operation string")).collect()
    assert {(r["goal"], r["place"]): (r["outcome"], r["revision_after"]) for r in got} == want


def plain_bounded(rows):
    kept, used = [], 0
    for place, url, text in sorted(rows, key=lambda r: r[0]):
        if url in [u for _, u, _ in kept] or len(kept) >= 5 or 6000 - used <= 0:
            continue
        found = udfs.excerpt_of(text, min(4200, int((6000 - used) / 1.5)))
        if found:
            used += sum(1.5 if ord(c) > 127 else 1 / 3 for c in found)
            kept.append((place, url, found))
    return kept


def test_bounded_sources(spark):
    rng = random.Random(3)
    rows = [(run, place, f"u{rng.randint(0, 7)}", rng.choice([None, "", " \n", "short", "日本語。" * rng.randint(1, 1500), "\n".join("line " * rng.randint(1, 300) for _ in range(9))])) for run in range(12) for place in range(rng.randint(1, 14))]
    d = spark.createDataFrame(rows, "run long, at long, url string, text string")
    got = folds.bounded_sources(d, "run", "at", "url", "text").collect()
    assert sorted((r["run"], r["place"], r["url"], r["excerpt"]) for r in got) == sorted((run, *x) for run in range(12) for x in plain_bounded([r[1:] for r in rows if r[0] == run]))
    assert folds.bounded_sources(d.limit(0), "run", "at", "url", "text").collect() == []


def test_excerpts_agree_with_the_column(spark):
    from tessera.functions import text as X

    texts = [None, "", "first\n\n \n\na line too long\n日本", "One. Two! 三。Four? five six seven", "\n\n x \x0b y z\r\nw\0v", "a\n\nmuch too long a line\n\nb", "a.b.c.d.e.f.g.h"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit in (6, 12, 4200):
        assert [r[0] for r in rows.orderBy("i").select(X.excerpt(F.col("t"), limit)).collect()] == [udfs.excerpt_of(t, limit) for t in texts]


@pytest.mark.parametrize(("how", "upto"), [("sum", 0), ("min", 0), ("max", 0), ("min", -1), ("sum", -1)])
def test_running(spark, how, upto):
    rng = random.Random(5)
    rows = [("hot" if k % 3 else f"g{k % 7}", k, rng.randint(-50, 50)) for k in range(300)] + [(None, 1, 5), (None, 2, -1)]
    d = spark.createDataFrame(rows, "g string, at long, v long")
    got = running(d, ["g"], [F.col("at").asc()], {"x": F.col("v")}, how, upto, parts=5).collect()
    of = {"sum": lambda xs: sum(xs), "min": lambda xs: min(xs, default=None), "max": lambda xs: max(xs, default=None)}[how]
    want = sorted(((g, at, v, of([r[2] for r in rows if r[0] == g and (r[1] < at or r[1] == at and not upto)])) for g, at, v in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_four_arms(spark):
    rng = random.Random(9)
    words = "alpha beta gamma delta epsilon zeta".split()
    memories = [(i, f"o{i % 3}", f"d{i % 2}", t := rng.randint(0, 30), f"{t:05d}", " ".join(rng.choices(words, k=4)), rng.choice(["yes", "no", "maybe", None])) for i in range(80)]
    cases = [(i, f"o{i % 4}", f"d{i % 3}", rng.randint(0, 32), " ".join(rng.choices(words, k=3)), ["yes", "no"]) for i in range(25)]
    m = spark.createDataFrame(memories, "id long, owner_id string, domain string, occurred long, occurred_text string, content string, choice string")
    c = spark.createDataFrame(cases, "case_id long, owner_id string, domain string, occurred long, question string, options array<string>")
    want = {}
    for case, owner, domain, at, question, options in cases:
        seen = [x for x in memories if x[1] == owner and x[3] < at]
        shared = sorted(seen, key=lambda x: (-len(set(x[5].split()) & set(question.split())), x[0]))
        arms = {"B0": [], "B1": sorted(seen, key=lambda x: (x[4], x[0]))[:1], "B2": shared[:2], "D": [x for x in seen if x[2] == domain]}
        for arm, entries in arms.items():
            last = max((x for x in entries if x[6] in options), key=lambda x: (x[4], x[0]), default=None)
            want[arm, case] = (last[6], last[0]) if last else ("ABSTAIN", None)
    got = {(r["arm"], r["case_id"]): (r["choice"], r["evidence_id"]) for r in E.four_arms(m, c).collect()}
    assert got == want


def test_vectors_of_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0]), (4, [1.0, None]), (5, []), (6, None), (7, [0.0, 0.0]), (8, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["place"]) for r in R.dense(d, F.col("vec_id") == 1, 3).collect()] == [(2, 1), (8, 2)]
    with pytest.raises(ValueError, match="vectors of 1 to 2"):
        R.dense(d, F.col("vec_id").isin(1, 3), 3)
    assert R.dense(d, F.col("vec_id") == 6, 3).collect() == []


def test_recall_abstains(spark):
    lists = spark.createDataFrame([("dense", 1, 10, 0.9, 1), ("lexical", 1, 10, 4.0, 1), ("lexical", 1, 11, 2.0, 2), ("lexical", 2, 12, 1.0, 1), ("lexical", 2, 13, 1.0, 2), ("lexical", 3, 14, 3.0, 1)], "channel string, item_id long, doc_id long, score double, place int")
    known = [(10, 90, None, None, 1.0, "ACTIVE"), (11, 90, None, None, 1.0, "SUPERSEDED"), (12, 50, None, 80, 0.5, "ACTIVE"), (13, 50, None, 80, 0.5, "ACTIVE"), (14, 50, None, None, 0.5, "DELETED")]
    memories = spark.createDataFrame(known, "doc_id long, occurred long, valid_from long, valid_to long, importance double, status string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id long")
    out = R.abstaining(R.recalled([lists], memories, F.lit(100), half_life=10.0, margin=0.05), asked).collect()
    got = sorted(((r["item_id"], r["place"], r["doc_id"]) for r in out), key=lambda x: (x[0], x[1] or 0))
    assert got == [(1, 1, 10), (1, 2, 11), (2, None, None), (3, None, None), (4, None, None)]
    first = next(r for r in out if r["place"] == 1)
    assert first["score"] == pytest.approx(0.3 * 0.9 + 0.25 + 0.15 * 0.5 + 0.1 + 0.1 + 0.1)


def test_fingerprints(spark):
    rows = [(f"o{i % 3}", i * 977, f"text {i}") for i in range(90)]
    d = spark.createDataFrame(rows, "owner_id string, id long, text string")
    first = {r["owner_id"]: r["fingerprint"] for r in V.fingerprint(d).collect()}
    assert len(set(first.values())) == 3
    assert {r["owner_id"]: r["fingerprint"] for r in V.fingerprint(d.union(d.limit(5)).repartition(7)).collect()} == first
    other = d.withColumn("text", F.when(F.col("id") == 977, "changed").otherwise(F.col("text")))
    assert [o for o, x in first.items() if {r["owner_id"]: r["fingerprint"] for r in V.fingerprint(other).collect()}[o] != x] == ["o1"]
    far = d.withColumn("id", F.col("id") + 2**50)
    assert V.fingerprint(far).count() == 3
    versions = spark.createDataFrame([("o0", "v1", first["o0"], "ACTIVE"), ("o1", "v2", first["o1"], "INVALIDATED"), ("o2", "v3", "x", "ACTIVE")], "owner_id string, version_id string, snapshot_hash string, state string")
    got = {r["owner_id"]: (r["version_id"], r["reused"]) for r in V.snapshots(d, versions, ["owner_id"]).collect()}
    assert got == {"o0": ("v1", True), "o1": (f"version_{first['o1']}", False), "o2": (f"version_{first['o2']}", False)}


def test_corrections_change_all_tables_at_once(spark):
    messages = spark.createDataFrame([(1, 7, 1, "USER"), (2, 7, 2, "AGENT"), (3, 8, 1, "USER"), (4, 8, 2, "AGENT")], "id long, conversation_id long, sequence long, speaker string")
    evidence = spark.createDataFrame([(10, 1, "ACTIVE"), (11, 3, "DELETED"), (12, None, "ACTIVE")], "id long, message_id long, status string")
    asked = spark.createDataFrame([(10, 2, "late", "work"), (10, 1, "better", "work"), (11, 1, None, None), (12, 1, None, None), (99, 1, None, None)], "evidence_id long, place long, text string, domain string")
    runs = spark.createDataFrame([(20, 7), (21, 8)], "id long, scope_id long")
    tasks = spark.createDataFrame([(30, [10, 5]), (31, [11]), (32, None)], "id long, evidence_ids array<long>")
    grants = spark.createDataFrame([(40, [12], 31), (41, [], 30), (42, [5], 31)], "id long, evidence_ids array<long>, assessment_id long")
    gone = C.withdrawn(asked, evidence, messages)
    got = {tuple(r)[:3] for r in C.change_set(gone, messages, runs, tasks, grants).collect()}
    assert got == {
        ("messages", "1", "BLANK"), ("messages", "2", "BLANK"), ("messages", "correction:10", "ADD"), ("evidence", "10", "DELETE_PENDING"), ("evidence", "12", "DELETE_PENDING"), ("evidence", "correction:10", "USER_CORRECTION"),
        ("outbox", "10", "DELETE"), ("outbox", "12", "DELETE"), ("research", "20", "INVALIDATED"), ("assessments", "30", "INVALIDATED"), ("grants", "40", "INVALIDATED"), ("grants", "41", "INVALIDATED"),
    }
    added = next(r for r in C.change_set(gone, messages, runs, tasks, grants).collect() if r["change"] == "ADD")
    assert added["detail"].startswith("7:3:")


def test_examples_for_a_topic(spark):
    examples = [("a", 0, "smalltalk", ["Tea"]), ("a", 1, "help", ["exam", ""]), ("a", 2, "help", None), ("a", 3, "challenge", []), ("b", 0, "joke", None), ("b", 1, "joke", None), ("b", 2, "help", None)]
    topics = [(1, "a", "HELP me with the exam, how shall I"), (2, "a", "nothing of that"), (3, "b", None), (4, "c", "hello"), (5, "a", "tea?")]
    d = voices.chosen_examples(spark.createDataFrame(examples, "voice string, place int, scene string, tags array<string>"), spark.createDataFrame(topics, "topic_id int, voice string, text string"))
    got = {}
    for r in sorted(d.collect(), key=lambda r: r["position"]):
        got.setdefault(r["topic_id"], []).append(r["place"])
    assert got == {1: [1, 2], 2: [0, 3], 3: [0, 1], 5: [0]}


def test_helper_names_do_not_clash(spark):
    new = spark.createDataFrame([(1, 5, "p", "l"), (1, 4, "q", "m")], "room long, at long, _place string, _last string")
    prior = spark.createDataFrame([(1, 3)], "room long, sequence long")
    assert sorted(tuple(r) for r in A.numbered(new, prior, "room", "at").collect()) == [(1, 4, "q", "m", 4), (1, 5, "p", "l", 5)]
    runs = spark.createDataFrame([(1, "x", "g"), (2, "y", "h")], "run long, v string, _gone string")
    assert sorted(tuple(r) for r in A.scrubbed(runs, runs.where("run = 1"), "run", ["v"]).collect()) == [(1, None, "g"), (2, "y", "h")]
