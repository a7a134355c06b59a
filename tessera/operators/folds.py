"""Folds over ordered rows whose state depends on all rows before: rows are dealt by key, sorted, and streamed past one state per key.

What is held is one state and one Arrow batch, however many rows a key has; a key's rows do pass through one task, as their order asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.udfs import excerpt_of

_NAMES = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
#: Distinct addresses, tokens in all, characters of one source; what a wide and any other character counts. Fixed values.
MOST_SOURCES, MOST_TOKENS, MOST_EXCERPT, WIDE, NARROW = 5, 6000, 4200, 1.5, 1 / 3


def folded(rows: DataFrame, by: str, order: Sequence[Column], begin: Callable, fields: dict[str, pa.DataType]) -> DataFrame:
    """by and `fields`, as the state of each key gives them at its end. rows: by and what begin().add() takes; begin().rows() gives tuples."""
    kind = rows.schema[by].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, schema = None, None, [], None
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *fields.items()])
            for now, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or now != key:
                    out += [] if state is None else [(key, *r) for r in state.rows()]
                    key, state = now, begin()
                state.add(*values)
            yield _batch(out, schema)
            out = []
        if state is not None:
            yield _batch([(key, *r) for r in state.rows()], schema)

    named = ", ".join(f"{n} {_NAMES[t]}" for n, t in fields.items())
    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(of, f"{by} {kind}, {named}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Bounded:
    """Sources while there is room: one row an address, a number of them, and tokens in all and each."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple] = {}
        self.used = 0.0

    def add(self, place: int, url: str, text: str | None) -> None:
        room = MOST_TOKENS - self.used
        if room <= 0 or url in self.kept or len(self.kept) >= MOST_SOURCES:
            return
        if found := excerpt_of(text, min(MOST_EXCERPT, int(room / WIDE))):
            wide = sum(ord(c) > 127 for c in found)
            self.used += wide * WIDE + (len(found) - wide) * NARROW
            self.kept[url] = place, url, found

    def rows(self) -> list[tuple]:
        return list(self.kept.values())


def bounded_sources(sources: DataFrame, run: str, place: str, url: str, text: str) -> DataFrame:
    """(run, place, url, excerpt, content_hash) of a run's sources in order, as far as both budgets reach. A source that leaves no whole line is passed over, and
    another of its address may come; rows without an address count as one; null texts are empty."""
    rows = sources.select(F.col(run), F.col(place).cast("long").alias("place"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(text).alias("text"))
    out = folded(rows, run, [F.col("place"), F.col("url")], _Bounded, {"place": pa.int64(), "url": pa.string(), "excerpt": pa.string()})
    return out.withColumn("content_hash", F.sha2("excerpt", 256))


class _Summary:
    """First sentences, newest first while they fit, after so many messages that are left out."""

    def __init__(self, last: int, sentence: int, total: int) -> None:
        self.skip, self.sentence, self.room, self.kept = last, sentence, total, []

    def add(self, sequence: int, first: str | None) -> None:
        if self.skip:
            self.skip -= 1
        elif first and len(first) <= min(self.sentence, self.room):
            self.kept.append(first)
            self.room -= len(first)

    def rows(self) -> list[tuple]:
        return [("\n".join(reversed(self.kept)),)] if self.kept else []


#: Where a message's first sentence ends. Fixed value.
FIRST_END = r"(?<=[。！？.!?])\s*|\n\s*\n"


def summaries(messages: DataFrame, last: int = 12, sentence: int = 500, total: int = 2400) -> DataFrame:
    """Per room: the first sentences of the messages before the last ones, newest first while they fit, then in order. messages: conversation_id, sequence, text.

    Rooms of which nothing is kept have no row; a sentence that does not fit is passed over. Only first sentences are shuffled.
    """
    first = F.element_at(F.split("text", FIRST_END, 2), 1)
    rows = messages.select("conversation_id", "sequence", F.when(F.length(first) <= sentence, first).alias("first"))
    return folded(rows, "conversation_id", [F.col("sequence").desc()], lambda: _Summary(last, sentence, total), {"summary": pa.string()})
