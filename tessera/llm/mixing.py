"""Mixing sources to target weights over a domain - language - source tree.

Weights propagate from the root: a node's share of its parent's budget is its weight over the weights of its siblings.
A leaf can give at most its tokens times `max_epochs`. What a leaf cannot give goes to its siblings first, by their
weights, and only what all of them cannot give goes on to the parent's siblings, and so on up.

A leaf's budget is then filled from seeded epochs: each epoch deals the leaf's documents in an order of its own (a hash of
seed, epoch and doc_id); whole epochs are taken as long as they fit, and of the next one the longest prefix whose tokens stay
within the budget. The order is by hash, so a leaf's prefix is everything below one cut value: the
cut is found from sums per hash range, narrowed until a range holds few rows, and is applied as a filter. No
leaf is gathered in a task, however large, and no text is shuffled. What the driver holds is one row per leaf; the tree of weights
bounds the leaves, as sources without a weight of their own share the leaf named `OTHER`.

Defined cases: a null domain, language or source belongs to `OTHER`; null and empty texts have no tokens, are never asked
for and are left out; rows equal in doc_id and leaf are taken or left together; rows with a null doc_id share one place in the order; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import fresh

OTHER = "other"
NARROW, FEW = 8, 2_000  # bits of the hash by which ranges are narrowed at a time; rows that one range may hold at the end


@dataclass
class Node:
    """A weight, and the nodes below; leaves have none."""

    weight: float = 1.0
    below: dict[str, Node] = field(default_factory=dict)


def tree(weights: dict) -> Node:
    """Nested dicts with numbers at the leaves; the key "" holds an inner node's own weight (1 if there is none)."""
    if not isinstance(weights, dict):
        return Node(float(weights))
    return Node(float(weights.get("", 1.0)), {k: tree(v) for k, v in weights.items() if k != ""})


def budgets(root: Node, capacity: dict[tuple[str, ...], float], total: float) -> dict[tuple[str, ...], float]:
    """Leaf path -> tokens to take. capacity: leaf path -> most that it can give."""
    room: dict[tuple[str, ...], float] = {}

    def sum_up(node: Node, path: tuple[str, ...]) -> float:
        room[path] = sum(sum_up(n, (*path, k)) for k, n in node.below.items()) if node.below else capacity.get(path, 0.0)
        return room[path]

    def give(node: Node, path: tuple[str, ...], amount: float) -> None:
        if not node.below:
            out[path] = min(amount, room[path])
            return
        left, share = min(amount, room[path]), {}
        open_ = {k: n.weight for k, n in node.below.items() if room[(*path, k)] > 0 and n.weight > 0}
        while open_ and left > 0:
            unit = left / sum(open_.values())
            full = [k for k, w in open_.items() if w * unit >= room[(*path, k)]]
            if not full:
                share |= {k: w * unit for k, w in open_.items()}
                break
            for k in full:  # these give all they have; their shortage stays in `left` for their siblings
                share[k] = room[(*path, k)]
                left -= share[k]
                del open_[k]
        for k, n in node.below.items():
            give(n, (*path, k), share.get(k, 0.0))

    out: dict[tuple[str, ...], float] = {}
    sum_up(root, ())
    give(root, (), total)
    return out


def _mapped(key: Column, values: dict[str, int]) -> Column:
    """values[key], null where there is none; values is a literal with an entry per leaf or node of the tree."""
    if not values:
        return F.lit(None).cast("long")
    return F.try_element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in values.items() for x in pair]), key)


def _leaf(root: Node, levels: list[Column]) -> Column:
    """The path of a row's leaf, joined by tabs: level by level the node of the row's own name, else OTHER, else no leaf (null)."""
    nodes: dict[str, int] = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        for k, n in node.below.items():
            nodes["\t".join((*path, k))] = int(not n.below)
            walk(n, (*path, k))

    walk(root, ())

    def known(path: Column) -> Column:
        return F.when(_mapped(path, nodes).isNotNull(), path)

    def down(level: Column) -> Callable[[Column], Column]:
        start = lambda p: F.when(p == "", p).otherwise(F.concat(p, F.lit("\t")))
        return lambda p: F.when(_mapped(p, nodes) == 1, p).otherwise(F.coalesce(known(F.concat(start(p), level)), known(F.concat(start(p), F.lit(OTHER)))))

    path = F.lit("")
    for level in levels:
        path = F.element_at(F.transform(F.array(path), down(level)), 1)
    return F.element_at(F.transform(F.array(path), lambda p: F.when(_mapped(p, nodes) == 1, p)), 1)


def place(seed: int, epoch: Column | int, doc_id: Column) -> Column:
    """Place of a document in an epoch's order, 0 to 2 ** 60 - 1, the same in any engine that has MD5."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")))), 1, 15), 16, 10).cast("long")


def words_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _at_leaf(leaf: Column, values: dict[str, int], default: int) -> Column:
    return F.coalesce(_mapped(leaf, values), F.lit(default).cast("long"))


def cuts(sized: DataFrame, goal: dict[str, int]) -> dict[str, int]:
    """leaf -> the first place that its prefix leaves out. sized: leaf, place, tokens; goal: leaf -> most tokens of the prefix.

    Each turn sums the tokens of 2 ** NARROW ranges of each leaf's open range and goes on in the range where the goal is
    passed, until that range is a single place or holds few rows, which are then gone through in order.
    """
    low, have, width, done = {k: 0 for k in goal}, {k: 0 for k in goal}, {k: 60 for k in goal}, {}

    def within(leaves: list[str], bits: dict[str, int]) -> DataFrame:
        """Rows of these leaves whose place is among the 2 ** bits from the leaf's low on, with their offset in that range."""
        start, span = _at_leaf(F.col("leaf"), {k: low[k] for k in leaves}, 0), _at_leaf(F.col("leaf"), {k: 2 ** bits[k] for k in leaves}, 0)
        rows = sized.where(F.col("leaf").isin(leaves)).withColumn("offset", F.col("place") - start)
        return rows.where((F.col("offset") >= 0) & (F.col("offset") < span))

    while active := [k for k in goal if k not in done]:
        bits, few = {k: max(0, width[k] - NARROW) for k in active}, []
        inside, offset = within(active, width), F.col("offset")
        shift = _at_leaf(F.col("leaf"), {k: 2 ** bits[k] for k in active}, 1)
        ranges = inside.groupBy("leaf", ((offset - F.pmod(offset, shift)) / shift).cast("long").alias("r"))
        got: dict[str, dict[int, tuple[int, int]]] = {k: {} for k in active}
        for row in ranges.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect():  # leaves x 2 ** NARROW rows at most
            got[row["leaf"]][row["r"]] = row["t"], row["n"]
        for k in active:
            for r, (t, n) in sorted(got[k].items()):
                if have[k] + t > goal[k]:
                    low[k] += r << bits[k]
                    width[k] = bits[k]
                    if not bits[k]:
                        done[k] = low[k]
                    elif n <= FEW:
                        few.append(k)
                    break
                have[k] += t
            else:
                done[k] = low[k] + 2 ** width[k]
        if few:  # at most FEW rows of each of them
            rows = within(few, width).groupBy("leaf", "place").agg(F.sum("tokens").alias("t")).collect()
            for _, k, place_of, tokens in sorted((x["place"], x["leaf"], x["place"], x["t"]) for x in rows):
                if k not in done:
                    if have[k] + tokens > goal[k]:
                        done[k] = place_of
                    have[k] += tokens
    return done


@dataclass
class Plan:
    """What each leaf gives: whole epochs, and the places below `cut` of the epoch after them."""

    leaf: Column
    seed: int
    epochs: dict[str, int]
    cut: dict[str, int]
    budget: dict[str, float]

    def times(self, doc_id: Column, tokens: Column) -> Column:
        """How many times a row is taken."""
        whole = _at_leaf(self.leaf, self.epochs, 0)
        below = place(self.seed, whole, doc_id) < _at_leaf(self.leaf, self.cut, 0)
        return F.when(tokens > 0, whole + below.cast("long")).otherwise(F.lit(0).cast("long"))


def plan(docs: DataFrame, weights: dict, levels: list[Column], fraction: float, max_epochs: int, seed: int, tokens: Callable[[Column], Column] = words_of, id_col: str = "doc_id", text: str = "text") -> Plan:
    """Budgets of `fraction` times the corpus's tokens, and where each leaf's prefix ends."""
    root = tree(weights)
    leaf = _leaf(root, levels)
    sized = docs.select(leaf.alias("leaf"), F.col(id_col).alias("doc_id"), tokens(F.col(text)).alias("tokens")).where("tokens > 0 and leaf is not null").checkpoint()
    have = {r["leaf"]: int(r["t"]) for r in sized.groupBy("leaf").agg(F.sum("tokens").alias("t")).collect()}  # a row per leaf of the tree
    total = fraction * sum(have.values())
    given = {"\t".join(k): v for k, v in budgets(root, {tuple(k.split("\t")): v * max_epochs for k, v in have.items()}, total).items()}
    epochs = {k: int(v // have[k]) for k, v in given.items() if have.get(k)}
    goal = {k: int(given[k] - n * have[k]) for k, n in epochs.items()}
    goal = {k: v for k, v in goal.items() if v > 0}
    placed = sized.select("leaf", "tokens", place(seed, _at_leaf(F.col("leaf"), epochs, 0), F.col("doc_id")).alias("place"))
    return Plan(leaf, seed, epochs, cuts(placed, goal) if goal else {}, given)


def mix(docs: DataFrame, weights: dict, levels: list[Column], fraction: float = 1.0, max_epochs: int = 1, seed: int = 17, tokens: Callable[[Column], Column] = words_of, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are taken, each as many times as it is taken."""
    planned = plan(docs, weights, levels, fraction, max_epochs, seed, tokens, id_col, text)
    times, copy = fresh(docs.columns, "times"), fresh(docs.columns, "copy")
    out = docs.withColumn(times, planned.times(F.col(id_col), tokens(F.col(text)))).where(F.col(times) > 0)
    if max_epochs > 1:
        out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return out.select(*[F.col(c) for c in docs.columns])
