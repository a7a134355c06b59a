"""Orders and their lines as the notices of schools, claims about them and the questions of applicants: texts whose facts the columns know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.figures import PROVINCES
from tessera.sources.tables import table

_PLACES = PROVINCES.split("|")
RANKS = (1001, 2112, 3223, 4334, 5445, 6556, 7667, 8778)


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """A row per order line: what its notice says of it, and what is claimed."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    key = F.col("o_orderkey")
    school = F.concat(F.lit("Z"), F.translate(F.col("l_suppkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("大学"))
    return line.join(o, F.col("l_orderkey") == key).select(
        key.alias("run"), F.concat_ws(":", key.cast("string"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("claim_id"), "l_linenumber", "l_returnflag", "l_linestatus", _pick(_PLACES, F.col("o_custkey") % len(_PLACES)).alias("province"), (key % 30 + 2000).cast("string").alias("year"),
        _pick(("物理", "历史", "理科"), key % 3).alias("branch"), school.alias("school"), (F.col("l_partkey") % 400 + 300).alias("score"), _pick(RANKS, F.col("l_partkey") % 8).alias("rank"),
        F.col("l_quantity").cast("long").alias("places"), (F.col("l_suppkey") % 400 + 300).alias("guess"),
    )


def notices(spark: SparkSession, d: str) -> DataFrame:
    """One source per order: year, place and branch, then a table with a row per line. An order has a few lines."""
    row = F.concat_ws("|", "school", "score", "rank", "places")
    rows = _facts(spark, d).groupBy("run", "year", "province", "branch").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("rows"))
    head = F.concat("year", F.lit("年 "), "province", F.lit(" "), "branch", F.lit("类 本科\n院校|最低分|最低位次|招生计划\n"))
    return rows.select("run", F.col("run").alias("source_id"), F.concat(head, F.array_join("rows.row", "\n")).alias("excerpt"), F.array().cast("array<string>").alias("years"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """One claim per line, equal lines making one; some with another score, a school of which there is no notice, or no year."""
    school = F.when(F.col("l_linenumber") == 7, F.regexp_replace("school", "^Z", "Y")).otherwise(F.col("school"))
    year = F.when(F.col("l_linenumber") % 3 != 0, F.concat("year", F.lit("年"))).otherwise("")
    score = F.col("score") + (F.col("l_returnflag") == "R").cast("int")
    text = F.concat(school, year, F.lit("投档最低分"), score.cast("string"), F.lit("，最低位次"), F.col("rank").cast("string"), F.lit("。先说两个条件。是否达到"), F.col("guess").cast("string"), F.lit("分不清楚。"))
    own = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("我考了"), F.col("guess").cast("string"), F.lit("分")))
    return _facts(spark, d).select("run", "claim_id", text.alias("text"), own.alias("supplied")).distinct()


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """What the one who asks has said, by order; some from elsewhere, of another branch or year, some nothing."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    place = _pick(_PLACES, (F.col("o_custkey") + (key % 7 == 0).cast("int")) % len(_PLACES))
    branch = F.when(key % 11 != 0, _pick(("物理", "历史", "理科"), key % 3)).when(key % 3 == 1, "物理").otherwise("历史")
    return o.where(key % 13 != 0).select(key.alias("run"), place.alias("province"), branch.alias("subjects"), (key % 30 + 2000 + (key % 5 == 0).cast("int")).cast("string").alias("year"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """An order as a message of its customer's room."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    place, other = (_pick(_PLACES, (key + k) % len(_PLACES)) for k in (0, 1))
    kind, says = key % 6, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(kind == 0, says("我在", place, "，想填报志愿"))
        .when(kind == 1, says("今年是", (key % 30 + 2000).cast("string"), "年，", _pick(("物理", "历史"), F.floor(key / 6) % 2)))
        .when(kind == 2, says("考了", (key % 400 + 300).cast("string"), "分"))
        .when(kind == 3, says("不是", place, "，想去", other))
        .when(kind == 4, says("位次", _pick(RANKS, key % 8).cast("string"), " ", _pick(("本科", "专科"), F.floor(key / 6) % 2)))
        .when(key % 25 == 5, "换个考生")
        .otherwise(says(place, "大学怎么样"))
    )
    return o.select(F.col("o_custkey").alias("conversation_id"), key.alias("sequence"), F.when(key % 4 < 3, "USER").otherwise("AGENT").alias("speaker"), text.alias("text"))


_LIST = "[" + ", ".join(f"'{p}'" for p in _PLACES) + "]"
_RANKS = f"[{', '.join(map(str, RANKS))}]"
FACTS = f"""facts AS (
  SELECT o_orderkey AS run, concat_ws(':', o_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS claim_id, l_linenumber, l_returnflag, l_linestatus, o_custkey, {_LIST}[CAST(o_custkey % {len(_PLACES)} AS INT) + 1] AS province, 2000 + o_orderkey % 30 AS year, o_orderkey % 3 AS branch,
    'Z' || translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || '大学' AS school, 300 + l_partkey % 400 AS score, {_RANKS}[CAST(l_partkey % 8 AS INT) + 1] AS rank,
    CAST(l_quantity AS BIGINT) AS places, 300 + l_suppkey % 400 AS guess
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
QUESTIONS = f"""questions AS (
  SELECT o_custkey AS conversation_id, o_orderkey AS sequence, o_orderkey % 6 AS kind, o_orderkey % 6 = 5 AND o_orderkey % 25 = 5 AS anew, {_LIST}[CAST(o_orderkey % {len(_PLACES)} AS INT) + 1] AS place,
    CAST(2000 + o_orderkey % 30 AS VARCHAR) AS year, CAST(300 + o_orderkey % 400 AS VARCHAR) AS score, CAST({_RANKS}[CAST(o_orderkey % 8 AS INT) + 1] AS VARCHAR) AS rank, o_orderkey // 6 % 2 = 0 AS even
  FROM orders WHERE o_orderkey % 4 < 3)"""
