"""Near-duplicate questions by SequenceMatcher's ratio, without comparing all pairs.

Two texts with a ratio of t or more differ by (1 - t)(|x| + |y|) inserted and deleted characters at most, as the characters that match are a common
subsequence. A deletion destroys two of a text's bigrams at most, an insertion one, so the two bags of bigrams share (|x| + |y|)(0.5 - 1.5 (1 - t)) - 1 at least.
Bags that share so many also share one of their rarest bigrams: the first |x| - 1 - (least share) + 1 in the order of rarity. Texts meet on those only, if their lengths allow
the ratio, and are then compared in full. No pair that could reach the ratio is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.udfs import similarity
from tessera.shared import materialise

THRESHOLD = 0.9


def bigrams(text: Column) -> Column:
    """A text's bag of bigrams as a set: the n-th of its kind is a member of its own. Texts of one character have one."""
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array(text))
    order = F.array_sort(pairs)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(x == a["last"], a["n"] + 1).otherwise(0)
        return F.struct(x.alias("last"), n.alias("n"), F.array_append(a["out"], F.concat(x, n.cast("string"))).alias("out"))

    return F.aggregate(order, start, step)["out"]


def least_shared(sizes: Column, threshold: float) -> Column:
    """Of two texts with so many characters together."""
    return F.ceil(F.round(sizes * (0.5 - 1.5 * (1 - threshold)), 6)) - 1


def near_questions(questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(owner_id, a, b, ratio): pairs of different texts of one owner with ratio(a, b) >= threshold, each text named by its smallest item_id, a the larger of the two.

    questions: item_id, owner_id, text. Texts are compared as normalised(); equal ones are one text, see `classes`. Texts without a word character, and rows
    without an id or owner, are left out. threshold must be over 2/3, where the bound on bigrams ends.
    """
    if threshold <= 2 / 3:
        raise ValueError("the bound on bigrams needs a threshold over 2/3")
    texts = materialise(classes(questions).groupBy("owner_id", "t").agg(F.min("item_id").alias("id")), "questions")
    n = F.length("t")
    shortest = F.ceil(F.round(n * (threshold / (2 - threshold)), 6))  # that a text of the ratio may have
    keep = F.greatest(n - 1, F.lit(1)) - F.greatest(least_shared(n + shortest, threshold), F.lit(1)) + 1
    grams = texts.select("owner_id", "id", n.alias("n"), keep.alias("keep"), F.explode(bigrams(F.col("t"))).alias("gram"))
    rarity = materialise(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "rarity")  # a bigram that only one text has finds none
    place = F.row_number().over(Window.partitionBy("owner_id", "id").orderBy("df", "gram"))
    alone = grams.join(rarity, "gram", "left_anti").groupBy("owner_id", "id").agg(F.count(F.lit(1)).alias("alone"))
    shared = grams.join(rarity, "gram").withColumn("place", place).join(alone, ["owner_id", "id"], "left")
    prefix = materialise(shared.where(F.col("place") + F.coalesce("alone", F.lit(0)) <= F.col("keep")).select("owner_id", "gram", "id", "n"), "prefix")
    x, y = (prefix.select("owner_id", "gram", F.col("id").alias(i), F.col("n").alias(f"n_{i}")) for i in ("a", "b"))
    fits = 2 * F.least("n_a", "n_b") >= threshold * (F.col("n_a") + F.col("n_b"))
    pairs = x.join(y, ["owner_id", "gram"]).where((F.col("a") > F.col("b")) & fits).select("owner_id", "a", "b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(texts.select("owner_id", F.col("id").alias(end), F.col("t").alias(f"t_{end}")), ["owner_id", end])
    return pairs.select("owner_id", "a", "b", similarity("t_a", "t_b").alias("ratio")).where(F.col("ratio") >= threshold)


def classes(questions: DataFrame) -> DataFrame:
    """questions (item_id, owner_id, text) with their text as it is compared."""
    known = questions.where("item_id is not null and owner_id is not null")
    return known.withColumn("t", X.normalised(F.col("text"))).where("length(t) > 0")


def crossing_questions(questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, owner_id, n_alike) of the questions for which another split of their owner has the same text or a near one; n_alike counts those texts. questions: item_id, owner_id, split, text.

    Equal texts are not expanded into pairs: per text the splits that hold it are kept, which are few.
    """
    rows = classes(questions)
    texts = rows.groupBy("owner_id", "t").agg(F.min("item_id").alias("id"), F.collect_set("split").alias("splits"))
    named = materialise(rows.select("item_id", "owner_id", "split", "t").join(texts, ["owner_id", "t"]).drop("t"), "named")
    held = named.groupBy("owner_id", "id").agg(F.first("splits").alias("splits"))
    near = near_questions(questions, threshold)
    both = near.select("owner_id", F.col("a").alias("id"), F.col("b").alias("other")).unionByName(near.select("owner_id", F.col("b").alias("id"), F.col("a").alias("other")))
    links = both.join(held.select("owner_id", F.col("id").alias("other"), F.col("splits").alias("other_splits")), ["owner_id", "other"])
    # per text and split: how many near texts stand in another split
    wanted = links.join(held, ["owner_id", "id"]).select("owner_id", "id", F.explode("splits").alias("split"), "other_splits")
    counts = wanted.groupBy("owner_id", "id", "split").agg(F.count_if(F.size(F.array_remove("other_splits", F.col("split"))) > 0).alias("n"))
    own = F.when(F.size(F.array_remove("splits", F.col("split"))) > 0, 1).otherwise(0)
    found = named.join(counts, ["owner_id", "id", "split"], "left").select("item_id", "owner_id", (F.coalesce("n", F.lit(0)) + own).cast("long").alias("n_alike"))
    return found.where("n_alike > 0")
