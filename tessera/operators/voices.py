"""Examples of how someone speaks, chosen for a topic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of a scene's word and of a tag; how many examples are chosen; scenes of which one stands in where nothing fits. Fixed values.
SCENE_POINTS, TAG_POINTS, CHOSEN, STAND_IN = 10, 1, 2, ("smalltalk", "challenge")

#: The words of a topic that call for a scene. Fixed values.
SCENES = {
    "correction": ("说错", "不对", "纠正", "反例", "改口", "你错", "更正", "correct", "wrong"),
    "distress": ("难受", "难过", "焦虑", "崩溃", "失眠", "害怕", "没用", "失落", "一文不值", "失败了", "痛苦", "撑不住", "活不下去", "自责", "sad", "upset"),
    "challenge": ("凭什么", "不同意", "不认同", "你确定", "胡说", "瞎说", "反对", "质疑", "disagree", "sure"),
    "unknown": ("最新", "现价", "实时", "你在哪", "你现在", "今天发生", "内幕", "current", "today"),
    "joke": ("笑话", "逗我", "开玩笑", "哈哈", "吹牛", "接梗", "好笑", "joke", "funny"),
    "help": ("怎么办", "怎么", "如何", "帮我", "建议", "教我", "下一步", "help", "how "),
    "smalltalk": ("你好", "吃饭", "聊聊", "随便聊", "无聊", "hello", "hi "),
}


def chosen_examples(examples: DataFrame, topics: DataFrame, scenes: Mapping[str, Sequence[str]] = SCENES, most: int = CHOSEN) -> DataFrame:
    """(topic_id, voice, position, place, score) of a voice's examples for each topic, one ranked union with a quota: those with most points, ties to the earlier; without any, the
    first of each scene that stands in, in that order; without those, the first ones.

    examples: voice, place, scene, tags; topics: topic_id, voice, text. An example has ten points for each of its scene's words in the topic and one for each of its tags, case folded; empty
    tags have none. A topic meets the examples of its own voice, which are few; a null topic has no words.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    hits = F.create_map(*[x for scene, words in scenes.items() for x in (F.lit(scene), sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)))])
    read = topics.select("topic_id", "voice", text.alias("topic"), hits.alias("hits"))
    tags = F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: (t != "") & F.contains(F.col("topic"), F.lower(t))))
    both = read.join(examples, "voice").select("topic_id", "voice", "place", "scene", (SCENE_POINTS * F.coalesce(F.try_element_at("hits", F.col("scene")), F.lit(0)) + TAG_POINTS * tags).alias("score"))
    of_topic = Window.partitionBy("topic_id", "voice")
    first_of_scene = F.row_number().over(Window.partitionBy("topic_id", "voice", "scene").orderBy("place")) == 1
    stands = F.when(first_of_scene, F.array_position(F.array(*map(F.lit, STAND_IN)), F.col("scene"))).otherwise(0)
    known = both.withColumn("stands", F.coalesce(stands, F.lit(0))).withColumn("best", F.max("score").over(of_topic)).withColumn("stand_in", F.max("stands").over(of_topic))
    kind = F.when(F.col("score") > 0, 0).when((F.col("best") == 0) & (F.col("stands") > 0), 1).when((F.col("best") == 0) & (F.col("stand_in") == 0), 2)
    order = of_topic.orderBy(F.desc("score"), "stands", "place")
    ranked = known.where(kind.isNotNull()).withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return ranked.select("topic_id", "voice", "position", "place", "score")
