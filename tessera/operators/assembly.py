"""Assembly of views and drafts: sequences, merges, references, limits, dependencies, research candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import host, official, public_url, trimmed
from tessera.scans import fresh

#: Shortest and longest reasons; limits of one research run. Fixed values.
REASON = (8, 4000)
ROUNDS, SEARCHES, ACTIONS = 2, 3, 4


def numbered(new: DataFrame, prior: DataFrame, room: str, order: str, sequence: str = "sequence") -> DataFrame:
    """New messages with the numbers after the last one of their room, in order. prior: room and sequence; an empty room starts at 1."""
    at, end = fresh(new.columns, "_place"), fresh(new.columns, "_last")
    last = prior.groupBy(room).agg(F.max(sequence).alias(end))
    place = F.row_number().over(Window.partitionBy(room).orderBy(order))
    return new.withColumn(at, place).join(last, room, "left").select(*[c for c in new.columns if c != sequence], (F.coalesce(end, F.lit(0)) + F.col(at)).cast("long").alias(sequence))


def guarded(rows: DataFrame, ids: DataFrame, guard: Column, id_col: str = "id") -> DataFrame:
    """The asked rows that the guard lets pass; what is not there and what is another's look alike."""
    return rows.where(guard).join(ids.select(id_col), id_col, "left_semi")


def merged_draft(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field by field the new value where there is one, else the old; a draft that was there goes up a version, and content_hash is that of its fields as they are then (nulls are empty).
    old: key, version, fields."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    values = [F.coalesce(f"n.{f}", f"o.{f}").alias(f) for f in fields]
    version = F.when(F.col(f"n.{key}").isNull(), F.col("o.version")).otherwise(F.coalesce("o.version", F.lit(0)) + 1)
    out = both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), version.cast("long").alias("version"), *values)
    return out.withColumn("content_hash", F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256))


def references(used: DataFrame, allowed: DataFrame, by: str, ref: str) -> DataFrame:
    """Per draft: how many distinct sources it names, how many of them there are not, and whether it stands (it invents none)."""
    found = used.select(by, ref).distinct().join(allowed.select(ref).distinct().withColumn("_real", F.lit(1)), ref, "left")
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n_sources"), (F.count(F.lit(1)) - F.count("_real")).alias("n_invented")).withColumn("stands", F.col("n_invented") == 0)


def shown_evidence(ranked: DataFrame, evidence: DataFrame, by: str, order: str, most: int = 3, length: int = 1000) -> DataFrame:
    """Of each ranking the first entries that may be shown, their text cut. ranked: by, id, order; evidence: id, text."""
    able = ranked.select(by, "id", order).join(evidence.select("id", "text"), "id")
    place = F.row_number().over(Window.partitionBy(by).orderBy(order, "id"))
    return able.withColumn("place", place).where(F.col("place") <= most).select(by, "id", "place", F.substring("text", 1, length).alias("shown"))


def dependents(links: dict[str, DataFrame], changed: dict[str, DataFrame]) -> DataFrame:
    """Sessions that rest on anything that changed. links: kind -> session, id; changed: kind -> id. One edge table, one semi-join."""
    return _tagged(links, "session", "id").join(_tagged(changed, "id").distinct(), ["kind", "id"], "left_semi").select("session").distinct()


def _tagged(tables: dict[str, DataFrame], *columns: str) -> DataFrame:
    """One table of several, with the name of each as kind."""
    return reduce(DataFrame.unionByName, [t.select(F.lit(kind).alias("kind"), *columns) for kind, t in tables.items()])


def progress(parts: DataFrame, by: str, done: Column, total: int) -> DataFrame:
    """Completed parts of a fixed total, in per cent to one place."""
    n = F.least(F.count_if(done), F.lit(total))
    return parts.groupBy(by).agg(n.alias("done"), F.round(n * 100.0 / total, 1).alias("percent"))


def repeated(segments: DataFrame, phrase: str, place: Sequence[str]) -> DataFrame:
    """Phrases and in how many different places they stand: REPEATED from two on."""
    found = segments.groupBy(phrase).agg(F.count_distinct(*place).alias("n_places"))
    return found.withColumn("kind", F.when(F.col("n_places") >= 2, "REPEATED").otherwise("SINGLE"))


def newest(rows: DataFrame, scope: str, valid: Column, order: Sequence[str], value: str) -> DataFrame:
    """Per scope the value of the newest valid row; null where none is valid."""
    at = F.struct(*order)
    return rows.groupBy(scope).agg(F.max_by(value, F.when(valid, at)).alias(value), F.count_if(valid).alias("n_valid"))


def rotated(cases: DataFrame, arms: Sequence[str], key: str = "case_id") -> DataFrame:
    """The arms of each case in an order of its own, by a hash: the same for everyone who computes it."""
    rows = cases.select(key, F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "arm"), 256)))
    return rows.withColumn("position", place)


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Rows of each group in batches of a fixed size, in order."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("long"))


#: Sources that one run may read. Fixed value.
READ = 5


def candidates(results: DataFrame, known: DataFrame, run: str, order: str, most: int = READ) -> DataFrame:
    """(run, position, url, authority, kind) of the results that a run goes on to read: public addresses that it does not know, each once, official ones first, else as they came, as
    many as it may still read beside those it knows.

    results: run, order, url, body; known: run, url. PAGE_CONTENT where there is a body, else SEARCH_SNIPPET. Only addresses are ranked; an address comes with the first result that has it.
    """
    found = results.select(run, order, public_url(F.col("url")).alias("url"), (F.length(trimmed(F.col("body"))) > 0).alias("read")).where("url is not null")
    first = found.groupBy(run, "url").agg(F.min_by(F.struct(order, "read"), order).alias("x"))
    new = first.join(known.select(run, public_url(F.col("url")).alias("url")), [run, "url"], "left_anti")
    taken = known.groupBy(run).agg(F.count_distinct("url").alias("taken"))
    authority = F.when(official(host(F.col("url"))), "OFFICIAL_DOMAIN").otherwise("PUBLIC_SOURCE")
    ranked = new.withColumn("authority", authority).withColumn("position", F.row_number().over(Window.partitionBy(run).orderBy(F.col("authority") != "OFFICIAL_DOMAIN", f"x.{order}")))
    kind = F.when(F.col("x.read"), "PAGE_CONTENT").otherwise("SEARCH_SNIPPET")
    return ranked.join(taken, run, "left").where(F.col("position") <= F.lit(most) - F.coalesce("taken", F.lit(0))).select(run, "position", "url", "authority", kind.alias("kind"))


def run_status(runs: DataFrame, found: DataFrame, run: str) -> DataFrame:
    """READY with the content of a page, SNIPPETS_ONLY without, NO_RESULTS without anything. found: run, kind."""
    got = found.groupBy(run).agg(F.bool_or(F.col("kind") == "PAGE_CONTENT").alias("pages"))
    return runs.select(run).distinct().join(got, run, "left").select(run, F.when(F.col("pages"), "READY").when(~F.col("pages"), "SNIPPETS_ONLY").otherwise("NO_RESULTS").alias("status"))


def answer_faults(choice: Column, reason: Column, stored: Column) -> Column:
    """The first rule that an answer breaks, null if none. A stored answer never changes."""
    return F.when(~F.coalesce(choice.isin("A", "B", "C"), F.lit(False)), "CHOICE").when(~F.coalesce(F.length(trimmed(reason)).between(*REASON), F.lit(False)), "REASON").when(stored.isNotNull() & (stored != choice), "CHANGED")


def over_limit(actions: DataFrame, run: str, kind: Column, round_: Column) -> DataFrame:
    """Runs by their number of rounds, searches and actions, and the first limit that they pass."""
    out = actions.groupBy(run).agg(F.count_distinct(round_).alias("rounds"), F.count_if(kind == "search").alias("searches"), F.count(F.lit(1)).alias("actions"))
    return out.withColumn("passed_limit", F.when(F.col("rounds") > ROUNDS, "ROUNDS").when(F.col("searches") > SEARCHES, "SEARCHES").when(F.col("actions") > ACTIONS, "ACTIONS"))


def source_type(namespace: Column, grammar: Sequence[tuple[str, str]]) -> Column:
    """The type of the first pattern that the whole namespace matches; null if none does. A line break at the end is part of the name."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(grammar):
        out = F.when(namespace.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(out)
    return out


def scrubbed(runs: DataFrame, gone: DataFrame, run: str, fields: Sequence[str]) -> DataFrame:
    """runs with the fields of invalidated ones set to null."""
    mark = fresh(runs.columns, "_gone")
    hit = runs.join(gone.select(run).distinct().withColumn(mark, F.lit(True)), run, "left")
    return hit.select(*[F.when(F.col(mark).isNull(), F.col(c)).alias(c) if c in fields else F.col(c) for c in runs.columns])
