"""KPI time series: grain, partial periods, period-over-period change."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.measures import Measure, evaluate, to_long

# Longest span in days per grain, and how near its end a period counts as whole.
GRAIN_SPANS = [("hour", 2), ("day", 62), ("month", 730), ("quarter", 2920)]
STEP = {"hour": "1 HOUR", "day": "1 DAY", "week": "7 DAY", "month": "1 MONTH",
        "quarter": "3 MONTH", "year": "12 MONTH"}
TOLERANCE = {"hour": "1 MINUTE", "day": "1 HOUR", "week": "1 DAY", "month": "1 DAY",
             "quarter": "1 DAY", "year": "1 DAY"}
DEFAULT_GRAIN = "month"


@dataclass(frozen=True)
class TimeRange:
    first: datetime | None
    last: datetime | None
    rows: int

    @property
    def grain(self) -> str:
        """The finest grain that still gives a readable number of points."""
        if self.rows < 2 or self.first is None:
            return DEFAULT_GRAIN
        days = (self.last - self.first).days
        return next((grain for grain, longest in GRAIN_SPANS if days <= longest), "year")


def time_range(df: DataFrame, ts: Column) -> TimeRange:
    """First and last observation; one row back, answered from column statistics or one scan."""
    ts = ts.cast("timestamp_ntz")
    row = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(ts).alias("rows")).first()
    return TimeRange(row["first"], row["last"], row["rows"])


def period_of(ts: Column, grain: str) -> Column:
    if grain not in STEP:
        raise ValueError(f"Unsupported grain {grain!r}")
    return F.date_trunc(grain, ts.cast("timestamp_ntz")).cast("timestamp_ntz")


def is_partial(period: Column, grain: str, last: Column) -> Column:
    """True when the data stops more than the tolerance before the period's end."""
    end = period + F.expr(f"INTERVAL {STEP[grain]}")
    return F.coalesce(end - F.expr(f"INTERVAL {TOLERANCE[grain]}") > last, F.lit(False))


def kpi_series(
    df: DataFrame,
    measures: Mapping[str, Measure],
    ts: Column,
    grain: str | None = None,
    seen: TimeRange | None = None,
    by: Mapping[str, Column] | None = None,
    where: Column | None = None,
    distinct: DataFrame | None = None,
) -> DataFrame:
    """``by + (kpi, period, value, partial)`` for all measures in one aggregation."""
    seen = seen or time_range(df, ts)
    grain = grain or seen.grain
    by = dict(by or {})
    wide = evaluate(df, measures, {**by, "period": period_of(ts, grain)}, where, distinct)
    last = F.lit(seen.last).cast("timestamp_ntz")
    return to_long(wide, [*by, "period"], list(measures)).withColumn(
        "partial", is_partial(F.col("period"), grain, last)
    )


def complete_points(series: DataFrame) -> DataFrame:
    """Points that may be compared with each other."""
    return series.where(~F.col("partial") & F.col("value").isNotNull())


def period_change(series: DataFrame, keys: list[str] = ["kpi"]) -> DataFrame:
    """Last two complete points per series, their change, and the partial tail left out.

    The change is over the previous value with its sign; null when that is zero or missing.
    """
    whole = ~F.col("partial") & F.col("value").isNotNull()
    latest = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    ranked = series.select(
        *keys,
        "period",
        "value",
        "partial",
        whole.alias("whole"),
        F.row_number().over(latest).alias("_place"),
        F.sum(whole.cast("int")).over(latest.rowsBetween(Window.unboundedPreceding, 0)).alias("_rank"),
    )

    def pick(rank: int, column: str) -> Column:
        return F.max(F.when(F.col("whole") & (F.col("_rank") == rank), F.col(column)))

    two = ranked.groupBy(*keys).agg(
        pick(1, "value").alias("current_value"),
        pick(2, "value").alias("previous_value"),
        pick(1, "period").alias("comparison_period"),
        pick(2, "period").alias("baseline_period"),
        F.max(F.when((F.col("_place") == 1) & F.col("partial"), F.col("period"))).alias("excluded_period"),
    )
    current, previous = F.col("current_value"), F.col("previous_value")
    return two.withColumn("change_pct", F.try_divide(current - previous, previous))
