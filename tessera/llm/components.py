"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import few

FEW_LINKS = 1_000_000  # 16 MB of links, which one task joins up at once; more take the steps


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some links, and for each the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, before[v], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
    if links:
        nodes, labels = joined_up(*np.concatenate(links, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rows: int) -> DataFrame:
    """(node, label): label is the smallest node that the node reaches. Only nodes with a link are listed.

    links has long columns a and b and about `rows` rows, by which the work is dealt out. Up to `FEW_LINKS` rows go through one task. Beyond, each step is a grouping with
    map-side sums and a join back; state is cut by checkpoint(). Links with a null say nothing; no links, no rows.
    """
    links = links.where("a is not null and b is not null")
    if rows <= FEW_LINKS:
        linked = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
        return linked.coalesce(1).mapInArrow(_at_once, "node long, label long")
    edges = few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), rows).checkpoint()
    before = _print(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows)
        edges = few(both.join(least, "u"), 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = few(edges, rows)
        least = few(edges.groupBy("u").agg(F.min("v").alias("m")), rows)
        edges = few(edges.join(least, "u"), rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = few(edges.distinct(), rows).checkpoint()
        now = _print(edges)
        if now == before:
            break
        before = now
    labels = few(edges.groupBy("u").agg(F.min("v").alias("label")), rows)
    return labels.union(few(labels.select("label", "label").distinct(), rows)).select(F.col("u").alias("node"), "label")
