"""Sums, minima and maxima along an order, for groups of any size: no group has to fit in one task."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import materialise

_OVER = {"sum": F.sum, "min": F.min, "max": F.max}
_WITH = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}  # least and greatest pass over nulls


def fresh(columns: Iterable[str], name: str) -> str:
    """name, or with underscores before it until none of the columns is called so (case does not count)."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], values: dict[str, Column], how: str = "sum", upto: int = 0, parts: int | None = None) -> DataFrame:
    """rows with, under each name of `values`, the sum (or "min", "max") over the rows of its group up to and including its own (upto=-1: to the one before, null
    where there is none but for sums). What is summed must not be null; minima and maxima pass over nulls.

    Rows are dealt by ranges of (by, order), so that a large group spans several parts; each part is taken in order, and what the group's
    earlier parts hold is added. Of what is carried over there are at most two rows a part. The table of dealt rows is written, so that parts
    stay as they are when an executor is lost; `rows` is read twice, as Spark samples it for the ranges. Rows that tie are taken in any order.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    over, both = _OVER[how], _WITH[how]
    names = [*rows.columns, *values]
    part, tie, spans = (fresh(names, c) for c in ("_part", "_tie", "_spans"))
    dealt = rows.withColumns({**values, tie: F.monotonically_increasing_id()}).repartitionByRange(n, *by, *order, tie)
    dealt = materialise(dealt.withColumn(part, F.spark_partition_id()), "dealt")

    group = Window.partitionBy(*by)
    earlier = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, part).agg(*[over(v).alias(v) for v in values]).withColumn(spans, F.count(F.lit(1)).over(group)).where(F.col(spans) > 1)
    carried = totals.select(*[F.col(c).alias(f"carried.{c}") for c in (*by, part)], *[over(v).over(earlier).alias(f"carried.{v}") for v in values])
    carried = materialise(carried, "carried")

    so_far = Window.partitionBy(part, *by).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, upto)
    within = dealt.withColumns({v: over(v).over(so_far) for v in values})
    same = F.col(part) == F.col(f"`carried.{part}`")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"`carried.{c}`"))
    found = within.join(carried, same, "left")
    return found.select(*rows.columns, *[both(F.col(v), F.col(f"`carried.{v}`")).alias(v) for v in values])
