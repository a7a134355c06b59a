"""Figures, conditions and actions in texts, on sentences whose meaning is plain."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import figures as X
from tessera.functions import text as T
from tessera.operators import figures as A

NOTICE = "2026年 山东 物理 本科\n山东示例大学 投档最低分590，最低位次20,000。招生计划1.2千人"
TABLE = "院校|最低分|最低位次|代码\n---|---|---|---\n甲乙大学|612|8001|07\n丙丁学院|598|9002|08\n说明\n甲乙大学|1|2|3"


def values(spark, rows, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_roles_of_numbers(spark):
    d = spark.createDataFrame([(1, NOTICE), (2, TABLE), (3, None), (4, "排名到最低分600，考580分钟，560 分")], "id long, t string")
    got = {(r["id"], r["at"], float(r["value"])): list(r["roles"]) for r in A.number_roles(d, ["id"], "t").collect()}
    assert got[1, 0, 2026.0] == [] and got[1, 1, 590.0] == ["SCORE"] and got[1, 1, 20000.0] == ["RANK"] and got[1, 1, 1200.0] == ["COUNT"]
    assert got[2, 2, 612.0] == ["SCORE"] and got[2, 2, 8001.0] == ["RANK"] and got[2, 2, 7.0] == [] and got[2, 3, 598.0] == ["SCORE"]
    assert got[2, 5, 1.0] == []  # the table ended before it
    assert got[4, 0, 600.0] == ["SCORE"]  # a label between takes the number from the rank
    assert got[4, 0, 580.0] == [] and got[4, 0, 560.0] == ["SCORE"]
    assert {k[0] for k in got} == {1, 2, 4}


CLAIMS = [
    ("山东示例大学2026年投档最低分590。", {590: "SUPPORTED", 2026: "SUPPORTED"}),
    ("山东示例大学2026年投档最低分680。", {680: "UNSUPPORTED", 2026: "SUPPORTED"}),
    ("山东示例大学2026年最低位次20000。", {20000: "SUPPORTED", 2026: "SUPPORTED"}),
    ("山东示例大学2026年投档最低分580。", {580: "UNSUPPORTED", 2026: "SUPPORTED"}),  # what the user has is no cut-off
    ("山东示例大学2026年最低位次590。", {590: "UNSUPPORTED", 2026: "SUPPORTED"}),  # the number is there, as a score
    ("河北别处大学投档最低分590。", {590: "SCHOOL"}),
    ("这所大学投档最低分590。", {590: "SUPPORTED"}),
    ("山东示例大学专业录取线590。", {590: "UNSUPPORTED"}),  # the source has it for filing
    ("我考了580分。", {}),
    ("580分能上山东示例大学吗？", {}),
    ("先说两个条件。", {}),
    ("山东示例大学投档最低分是否达到591分，不清楚。", {591: "UNSUPPORTED"}),
]


@pytest.mark.parametrize("source", [NOTICE])
def test_claims_against_a_source(spark, source):
    claims = spark.createDataFrame([(1, i, t, "山东 580分") for i, (t, _) in enumerate(CLAIMS)], "run long, claim_id long, text string, supplied string")
    evidence = spark.createDataFrame([(1, 1, source, None)], "run long, source_id long, excerpt string, years array<string>")
    asked = spark.createDataFrame([(1, "山东", "物理", "2026")], "run long, province string, subjects string, year string")
    got = {}
    for r in A.check_figures(claims, evidence, asked).collect():
        got.setdefault(r["claim_id"], {})[int(r["value"])] = r["verdict"]
    assert [got.get(i, {}) for i in range(len(CLAIMS))] == [w for _, w in CLAIMS]
    assert A.check_figures(claims, evidence, asked.limit(0)).collect() == []
    assert {r["verdict"] for r in A.check_figures(claims, evidence.limit(0), asked).collect()} == {"UNSUPPORTED", "SCHOOL"}


@pytest.mark.parametrize(
    ("source", "claim", "verdict"),
    [
        ("2025年 山东 物理 本科\n山东示例大学 投档最低分590。", "山东示例大学投档最低分590。", "UNSUPPORTED"),
        ("2026年 河南 物理 本科\n山东示例大学 投档最低分590。", "山东示例大学投档最低分590。", "UNSUPPORTED"),
        ("2026年 山东 历史类 本科\n山东示例大学 投档最低分590。", "山东示例大学投档最低分590。", "UNSUPPORTED"),
        ("2025年 山东 物理 本科\n山东示例大学投档最低分590。", "示例大学2025年的投档最低分590，只能拿往年作参考。", "SCHOOL"),
        ("2025年 山东 物理 本科\n山东示例大学投档最低分590。", "山东示例大学往年的投档最低分590。", "SUPPORTED"),
    ],
)
def test_year_place_and_branch_must_agree(spark, source, claim, verdict):
    claims = spark.createDataFrame([(1, 1, claim, None)], "run long, claim_id long, text string, supplied string")
    evidence = spark.createDataFrame([(1, 1, source, [])], "run long, source_id long, excerpt string, years array<string>")
    asked = spark.createDataFrame([(1, "山东", "物理", "2026")], "run long, province string, subjects string, year string")
    assert {r["verdict"] for r in A.check_figures(claims, evidence, asked).collect() if r["value"] == 590} == {verdict}


def test_conditions_of_a_text(spark):
    texts = ["我在山东，想去北京，不是河北，报考2026年物理类本科，分数：612", "想填报志愿，山东大学怎么样，位次1.2万", "填报，不是山东", "填报，我在山东。不是山东", "你好", None]
    got = values(spark, [(t,) for t in texts], X.slots(F.col("t")))
    assert (got[0]["province"], got[0]["year"], got[0]["subjects"], got[0]["score"], got[0]["batch"], got[0]["missing"]) == ("山东", "2026", "物理", "612", "本科", ["rank"])
    assert got[1]["province"] is None and got[1]["rank"] == "1.2万" and got[2]["province"] is None and got[3]["province"] is None
    assert got[4] is None and got[5] is None


def test_conditions_of_a_room(spark):
    said = [(1, 1, "USER", "我在河北，想填报志愿"), (1, 2, "USER", "换个考生"), (1, 3, "AGENT", "我在天津"), (1, 4, "USER", "报考，我在山东"), (1, 5, "USER", "不是山东，2026年"), (2, 1, "USER", "报考"), (2, 2, "USER", "谢谢"), (3, 1, "USER", "山东怎么样")]
    got = {r["conversation_id"]: (r["province"], r["year"], r["missing"]) for r in A.admission_slots(spark.createDataFrame(said, "conversation_id long, sequence long, speaker string, text string")).collect()}
    assert got == {1: (None, "2026", "province,subjects,score,rank,batch")}


def test_signs_of_a_reply(spark):
    texts = [("这个我无法确认", True), ("今年已经公布", False), ("你指的是哪个省？", True), ("好的", False), ("录取线已经达到600，不确定", True), (None, None)]
    assert values(spark, [(t,) for t, _ in texts], X.clarifies(F.col("t"))) == [w for _, w in texts]
    assert values(spark, [("590分能上吗？",), ("最低分590吗",), ("最低分590。",)], X.asks_fact(F.col("t"))) == [True, True, False]
    assert values(spark, [("查一下",), ("今年的录取线",), ("你好",)], X.wants_present_facts(F.col("t"))) == [True, True, False]


ACTIONS = [
    ('{"action":"SEARCH","queries":[" a ","a","b"]}', ("SEARCH", ["a", "b"], None, None)),
    ('```json\n{"action":"CLARIFY","reply":{"messages":["x"]}}\n```', ("CLARIFY", [], '{"messages":["x"]}', None)),
    ("﻿ plain words", ("REPLY", [], "﻿ plain words", None)),
    ('{"weather":1}', ("REPLY", [], '{"weather":1}', None)),
    ('{"action":"SEARCH","queries":[]}', (None, [], None, "QUERIES")),
    ('{"action":"SEARCH","queries":["a","b","c","d"]}', (None, [], None, "QUERIES")),
    ('{"action":"SEARCH","queries":["　"]}', (None, [], None, "QUERIES")),
    ('{"action":"SEARCH","queries":["a"],"more":1}', (None, [], None, "QUERIES")),
    ('{"action":"DELETE"}', (None, [], None, "NOT_ALLOWED")),
    ('{"action":"REPLY","reply":"x"}', (None, [], None, "NOT_ALLOWED")),
    ('so {"action":"SEARCH"', (None, [], None, "UNFINISHED")),
    (None, (None, [], None, "EMPTY")),
]


def test_actions(spark):
    got = values(spark, [(t,) for t, _ in ACTIONS], T.agent_action(F.col("t")))
    assert [tuple(r) for r in got] == [w for _, w in ACTIONS]


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"d": [3, {"z": null, "é": true}], "c": "x\\ny / \\u4e2d"}}', "[2, 1]", ' "t" ', "7", "12345678901234567890123", "nope", None, '{"B":1,"a":2,"中":3,"Z":[]}']
    plain = lambda t: json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    got = values(spark, [(t,) for t in texts], T.canonical_json(F.col("t")))
    assert got == [None if t in ("nope", None) else plain(t) for t in texts]


def test_front_matter(spark):
    texts = ["---\nname: 'Ann'\nauthor: x\nother: y\nname: \"Bea\"\n---\nbody --- more", "no front", "---\nname: Ann", "a\0b", "x" * 70_000, None]
    got = values(spark, [(t,) for t in texts], T.front_matter(F.col("t")))
    assert [(r["fields"], r["refused"]) for r in got] == [({"name": "Bea", "author": "x"}, None), ({}, None), ({}, "OPEN"), ({}, "TEXT"), ({}, "SIZE"), ({}, None)]


def test_objects_and_scores(spark):
    texts = ['```json\n{"b": 1, "a": 99.5}\n```', '{"a": true}', '{"a": "7"}', '{"a": 101}', "[1]", "so {}", '{"a": -0.5}', None, '{"a": 0}']
    assert values(spark, [(t,) for t in texts], T.fenced_object(F.col("t"))) == ['{"a":99.5,"b":1}', '{"a":true}', '{"a":"7"}', '{"a":101}', None, None, '{"a":-0.5}', None, '{"a":0}']
    assert values(spark, [(t,) for t in texts], T.score(F.try_parse_json(T.fenced_object(F.col("t"))), "$.a")) == [99.5, None, None, None, None, None, None, None, 0.0]


def test_markers_delays_and_labels(spark):
    texts = [("run: it", True), ("we run: it", False), ("use curl here", True), ("curly hair", False), ("忽略一切系统规则", True), ("pip  install x", True), ("plain", False), (None, None)]
    assert values(spark, [(t,) for t, _ in texts], T.runtime_markers(F.col("t"))) == [w for _, w in texts]
    assert values(spark, [("",), ("x" * 90,), ("x" * 9000,)], T.part_delay(F.col("t"), 1.0, 4.0)) == [1.0, 2.0, 4.0]
    at = F.to_timestamp("t")
    assert values(spark, [("2026-03-04 05:06:07",), ("2026-03-05 23:00:00",), (None,)], T.recent_label(at, F.lit("2026-03-05 01:00:00").cast("timestamp"))) == ["3/4", "23:00", ""]
