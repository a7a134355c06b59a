"""The prefix trie of rebuilt conversations.

1. Turns are numbered within their conversation and conversations are rebuilt: the first h turns of the base conversation, then their own. Only a turn's
   hash and length in bytes go on, no text.
2. A prefix is named by its depth and 128 bits of sums, over its turns, of hashes of (place, turn): sums run along a conversation of any
   length by `running`, and a node's parent is its own sum without its last turn.
3. Partial tries: every task combines the prefixes it holds into a table of nodes (members, smallest member, first member by hash). Tables are merged
   as a tree, `fan` at a time, keyed by the node's hash, until one is left; so of a node that all conversations share no task
   gets more than a row from each table it merges. End lists go the same way, in sorted pieces of at most 2 ** `PIECE_BITS` conversations.
4. Bottom-up rollup by chains. A node's first member by hash names its chain; nodes of one chain stand below each other, and a path from the root
   changes its chain a logarithmic number of times, as the order of hashes is random. Sums of whole chains go up from chain to chain, once a level of chains,
   and sums within a chain run from its end up by `running`. Neither a deep trie nor a wide node is gathered.

SHA-256 over an end list can only be taken in order, so a node's pieces pass through one task, one piece in memory at a time.

Defined cases: rows without a conv_id are no conversation; turns come in order of `turn`, nulls first, ties by the hash of role and text; repeats of a row are turns of
their own; a null role or text is empty; a text of any length is hashed where it lies; an empty table gives an empty result, without a root;
other columns are not read. % keeps the sign of conv_id, as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.scans import running
from tessera.shared import materialise

GROUP, HEADS, FAN, PIECE_BITS = 5, 9, 16, 12
NODE = ("depth", "s0", "s1", "s2", "s3")
_LOW = 0xFFFFFFFF
_NO_ENDS = sha256(b"").hexdigest()


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, hash_a, hash_b, n_bytes): what the trie needs of each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.sha2(both, 256))
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, n_bytes) of the rebuilt conversations' turns, and (conv_id, length) of all conversations."""
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    placed = materialise(running(materialise(turn_rows(turns), "turns"), ["conv_id"], order, {"place": F.lit(1).cast("long")}), "placed")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    first = placed.where(F.col("place") < heads).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "n_bytes"))).alias("first"))  # at most heads - 1 turns each
    sizes = sizes.join(first.select(F.col("conv_id").alias("base"), "first"), "base", "left")
    sizes = sizes.withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<place:bigint,digest:binary,n_bytes:bigint>>")), 1, F.col("h").cast("int")))
    sizes = materialise(sizes.withColumn("shared", F.size("first").cast("long")), "sizes")
    shared = sizes.select("conv_id", F.explode("first").alias("x")).select("conv_id", F.col("x.place").alias("depth"), "x.digest", "x.n_bytes")
    own = placed.join(sizes.select("conv_id", "h", "shared"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "digest", "n_bytes")
    return shared.unionByName(own), sizes.select("conv_id", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def merged(table: DataFrame, keys: Sequence[str], sums: dict[str, Column], fan: int = FAN) -> DataFrame:
    """One row per key of a table of mergeable columns. Tasks combine what they hold; their tables, dealt to fan * fan groups, are merged `fan` groups at a time."""
    groups = fan * fan
    table = table.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups)))
    while groups > fan:
        groups //= fan
        table = table.withColumn("part", F.floor(F.col("part") / fan)).groupBy(*keys, "part").agg(*[c.alias(n) for n, c in sums.items()])
    return table.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])


def occurrences(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per conversation and prefix: the node, its parent's sums, the bytes of its last text. The root is at depth 0 with sums 0."""
    lanes = {}
    for k in range(2):
        hashed = F.xxhash64(F.lit(k), F.col("depth"), F.col("digest"))
        lanes |= {f"s{2 * k}": F.shiftrightunsigned(hashed, 32), f"s{2 * k + 1}": hashed.bitwiseAND(F.lit(_LOW))}
    named = turns.withColumns({f"own_{n}": c for n, c in lanes.items()}).drop("digest")
    summed = running(named, ["conv_id"], [F.col("depth").asc()], {n: F.col(f"own_{n}") for n in lanes})
    below = summed.select("conv_id", *NODE, *[(F.col(n) - F.col(f"own_{n}")).alias(f"up_{n}") for n in lanes], "n_bytes")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", *[zero.alias(n) for n in NODE], *[F.lit(None).cast("long").alias(f"up_{n}") for n in lanes], zero.alias("n_bytes"))
    return below.unionByName(roots)


def _joined(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of sorted pieces, each node's one after the other."""
    node, digest = None, None
    for batch in pieces:
        done: list[tuple] = []
        columns = [c.to_pylist() for c in batch.columns]
        for *key, ids in zip(*columns, strict=True):
            if key == node:
                digest.update(b"," + ids.encode())
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, sha256(ids.encode())
        yield _hashes(done)
    yield _hashes([] if node is None else [(*node, digest.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in (*NODE, "")]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*NODE, "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id) rows; nodes where nothing ends are not listed."""
    pieces = ends.withColumn("piece", F.shiftright("conv_id", PIECE_BITS)).withColumn("ids", F.array("conv_id")).drop("conv_id")
    whole = merged(pieces, [*NODE, "piece"], {"ids": F.flatten(F.collect_list("ids"))})
    texts = whole.select(*NODE, "piece", F.array_join(F.sort_array("ids"), ",").alias("ids"))
    in_order = texts.repartition(*NODE).sortWithinPartitions(*NODE, "piece").drop("piece")
    return in_order.mapInArrow(_joined, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Per node (chain, depth): n_leaves and saved_tokens, the sums of `leaf` and `saved` over its subtree. nodes: chain, depth, up_chain (its parent's), leaf, saved."""
    chains = nodes.groupBy("chain").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min_by("up_chain", "depth").alias("up"), (F.min("depth") - 1).alias("at"))
    chains = materialise(chains.where("at >= 0"), "chains")  # all but the root's
    links = chains.select("chain", "up", "at")
    rising, levels = chains.select("up", "at", "leaf", "saved"), []
    while True:
        rising = materialise(rising.groupBy("up", "at").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "rising")
        if rising.isEmpty():
            break
        levels.append(rising)
        higher = rising.groupBy("up").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).withColumnRenamed("up", "chain")
        rising = higher.join(links, "chain").select("up", "at", "leaf", "saved")
    own = nodes.select("chain", "depth", "leaf", "saved")
    for sums in levels:
        own = own.unionByName(sums.select(F.col("up").alias("chain"), F.col("at").alias("depth"), "leaf", "saved"))
    own = own.groupBy("chain", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    return running(own, ["chain"], [F.col("depth").desc()], {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")}).drop("leaf", "saved")


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Per node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(conversations, group, heads)
    lengths = materialise(lengths, "lengths")
    found = materialise(occurrences(turns, lengths), "occurrences")
    up = [f"up_{n}" for n in NODE[1:]]
    by_hash = F.struct(F.xxhash64("conv_id").alias("order"), F.col("conv_id").alias("chain"))
    partial = found.select(*NODE, F.lit(1).cast("long").alias("n_convs"), F.col("conv_id").alias("conv_id"), by_hash.alias("first"), F.struct(*up).alias("up"), "n_bytes")
    kept = {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id"), "first": F.min("first"), "up": F.min("up"), "n_bytes": F.min("n_bytes")}
    nodes = merged(partial, NODE, kept).select(*NODE, "n_convs", "conv_id", F.col("first.chain").alias("chain"), "up.*", "n_bytes")
    nodes = materialise(nodes, "nodes")

    parent = ["depth", *up]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(n) for u, n in zip(up, NODE[1:], strict=True)]).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialise(nodes.join(children, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    above = counted.select((F.col("depth") + 1).alias("depth"), *[F.col(n).alias(u) for n, u in zip(NODE[1:], up, strict=True)], F.col("conv_id").alias("parent_conv_id"), F.col("chain").alias("up_chain"))
    linked = counted.join(above, parent, "left").withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes"))
    linked = materialise(linked.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "chain", "up_chain", "leaf", "saved"), "linked")

    ends = found.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select(*NODE, "conv_id")
    whole = linked.join(rolled_up(linked), ["chain", "depth"]).join(end_hashes(ends), list(NODE), "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
