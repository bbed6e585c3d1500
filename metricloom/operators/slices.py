"""Interactive slices: filters, one KPI under a slice, filter options, relative ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.text import like_literal
from metricloom.operators.measures import Measure, evaluate
from metricloom.operators.series import period_of, time_range

OPTIONS = 100  # values offered per label unless the caller says otherwise


@dataclass(frozen=True)
class Filter:
    column: str
    op: str = "eq"
    values: Sequence[Any] = field(default_factory=tuple)


def predicate(df: DataFrame, item: Filter) -> Column:
    """One filter as a condition; values are cast to the column's type, so it can be pushed down."""
    target = F.col(item.column)
    if item.op == "is_null":
        return target.isNull()
    if item.op == "not_null":
        return target.isNotNull()
    if not item.values:
        raise ValueError(f"Filter on {item.column} with op {item.op} needs a value")
    if item.op == "contains":
        return like_literal(target.cast("string"), f"%{item.values[0]}%")
    dtype = df.select(target).schema[0].dataType
    values = [F.lit(v).try_cast(dtype) for v in item.values]
    if item.op in ("in", "not_in"):
        found = target.isin(*values)
        return found if item.op == "in" else ~found
    if item.op == "between":
        if len(values) != 2:
            raise ValueError("between needs exactly two values")
        return target.between(*values)
    compare = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
    if item.op not in compare:
        raise ValueError(f"Unsupported filter {item.op!r}")
    return getattr(target, compare[item.op])(values[0])


def all_of(df: DataFrame, filters: Sequence[Filter]) -> Column | None:
    combined = None
    for item in filters:
        one = predicate(df, item)
        combined = one if combined is None else combined & one
    return combined


def slice_kpi(
    df: DataFrame,
    measure: Measure,
    filters: Sequence[Filter] = (),
    dimension: str | None = None,
    grain: str | None = None,
    limit: int = 25,
) -> DataFrame:
    """One KPI under filters: ``value``, or ``dimension, value, truncated`` when grouped.

    One row beyond the limit is read to tell whether groups were left out.
    """
    where = all_of(df, filters)
    if dimension is None:
        return evaluate(df, {"value": measure}, where=where)
    target = F.col(dimension)
    key = period_of(target, grain) if grain else target
    groups = evaluate(df, {"value": measure}, {"dimension": key}, where)
    order = [F.col("dimension")] if grain else [F.col("value").desc_nulls_last(), F.col("dimension")]
    limit = max(1, limit)
    top = groups.orderBy(*order).limit(limit + 1)
    everything = Window.partitionBy(F.lit(1))  # at most limit + 1 rows
    return (
        top.withColumn("_place", F.row_number().over(everything.orderBy(*order)))
        .withColumn("truncated", F.count(F.lit(1)).over(everything) > limit)
        .where(F.col("_place") <= limit)
        .drop("_place")
    )


def filter_options(df: DataFrame, dates: Sequence[str], labels: Sequence[str], keep: int = OPTIONS) -> DataFrame:
    """What a user may filter by: date ranges, and the ``keep`` most frequent values of each label.

    All labels are counted in one long aggregation. ``distinct_values`` tells how many values a
    label has, ``truncated`` whether some of them are left out.
    """
    parts = []
    if dates:
        ranges = df.agg(*[f(F.col(c).cast("timestamp_ntz")).alias(f"{n}_{i}")
                          for i, c in enumerate(dates) for n, f in (("min", F.min), ("max", F.max))])
        rows = F.array(*[
            F.struct(F.lit(c).alias("dimension"), F.lit("datetime").alias("type"),
                     F.col(f"min_{i}").cast("string").alias("min"), F.col(f"max_{i}").cast("string").alias("max"))
            for i, c in enumerate(dates)])
        parts.append(ranges.select(F.inline(rows)))
    if labels:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in labels]).unpivot([], list(labels), "dimension", "value")
        order = Window.partitionBy("dimension").orderBy(F.col("rows").desc(), "value")
        counted = long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))
        sizes = counted.groupBy("dimension").agg(F.count(F.lit(1)).alias("distinct_values"))  # a row per label
        parts.append(
            counted.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= keep)
            .join(sizes, "dimension")
            .withColumns({"type": F.lit("categorical"), "truncated": F.col("distinct_values") > keep})
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def relative_range(df: DataFrame, ts: str, months: int | None) -> DataFrame:
    """Rows of the last ``months`` months, counted back from the last date present.

    Bounds are whole dates. A day the earlier month does not have runs over into the next
    one. The bounds are literals, so the range filter reaches the scan.
    """
    if months is None:
        return df
    last = time_range(df, F.col(ts)).last
    if last is None:
        return df
    start, end = month_bounds(last, months)
    dtype = df.schema[ts].dataType
    cast = "date" if isinstance(dtype, T.DateType) else dtype.simpleString()
    return df.where(F.col(ts).between(F.lit(start).cast(cast), F.lit(end).cast(cast)))


def month_bounds(last: datetime, months: int) -> tuple[str, str]:
    index = last.year * 12 + last.month - 1 - months
    start = datetime(index // 12, index % 12 + 1, 1) + timedelta(days=last.day - 1)
    return start.strftime("%Y-%m-%d"), last.strftime("%Y-%m-%d")
