"""Statistics over KPI series and over tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.ranks import clean_cuts, cut_sketch, running_total
from metricloom.session import settle

# Fixed values
Z_LIMIT, MIN_POINTS, MIN_TREND_POINTS, MIN_SEASON_POINTS = 2.5, 4, 3, 6
IQR_REACH, TREND_R2 = 1.5, 0.2
PARETO_SHARE, PARETO_ITEMS = 0.8, 25
MIN_PAIR_ROWS, KEPT_PAIRS = 10, 20
#: Rows whose products one step of a task takes.
MOMENT_ROWS = 4096


def _indexed(points: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Window]:
    """Complete points numbered from 0 in period order. A series has one row per period."""
    series = Window.partitionBy(*keys)
    numbered = points.where(F.col("value").isNotNull()).withColumn(
        "index", F.row_number().over(series.orderBy("period")) - 1
    )
    return numbered, series


def zscore_anomalies(points: DataFrame, keys: Sequence[str] = ("kpi",), limit: float = Z_LIMIT) -> DataFrame:
    """Points at least ``limit`` sample deviations from their series mean."""
    rows, series = _indexed(points, keys)
    n, mean, std = F.count("value").over(series), F.avg("value").over(series), F.stddev_samp("value").over(series)
    scored = rows.select(
        *keys, "period", "index", "value",
        n.alias("_n"), F.when(std > 0, (F.col("value") - mean) / std).alias("zscore"),
    )
    return scored.where((F.col("_n") >= MIN_POINTS) & (F.abs("zscore") >= limit)).select(
        *keys, "period", "index", "value", "zscore", F.lit("zscore").alias("method")
    )


def iqr_outliers(points: DataFrame, keys: Sequence[str] = ("kpi",)) -> DataFrame:
    """Points beyond 1.5 interquartile ranges, with interpolated quartiles."""
    rows, series = _indexed(points, keys)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(series)
    bounded = rows.withColumn("_n", F.count("value").over(series)).withColumn("_q", q)
    reach = (F.col("_q")[1] - F.col("_q")[0]) * IQR_REACH
    outside = (F.col("value") < F.col("_q")[0] - reach) | (F.col("value") > F.col("_q")[1] + reach)
    return bounded.where((F.col("_n") >= MIN_POINTS) & (reach != 0) & outside).select(
        *keys, "period", "index", "value", F.lit("iqr").alias("method")
    )


def anomalies(points: DataFrame, keys: Sequence[str] = ("kpi",)) -> DataFrame:
    """Both tests, one row per test that flags a point."""
    return zscore_anomalies(points, keys).unionByName(iqr_outliers(points, keys), allowMissingColumns=True)


def linear_trend(points: DataFrame, keys: Sequence[str] = ("kpi",)) -> DataFrame:
    """Least squares over the point number: slope, intercept, r2 and a direction."""
    rows, _ = _indexed(points, keys)
    x, y = F.col("index").cast("double"), F.col("value")
    fit = rows.groupBy(*keys).agg(
        F.count("value").alias("points"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    enough = F.col("points") >= MIN_TREND_POINTS
    strong = F.col("r2") >= TREND_R2
    direction = (
        F.when(~enough, "insufficient_data")
        .when(strong & (F.col("slope") > 0), "up")
        .when(strong & (F.col("slope") < 0), "down")
        .otherwise("flat")
    )
    return fit.select(
        *keys, "points", direction.alias("direction"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")],
    )


def peak_trough(points: DataFrame, keys: Sequence[str] = ("kpi",)) -> DataFrame:
    """Strongest and weakest period and the spread between them; the earlier one wins ties."""
    rows, _ = _indexed(points, keys)
    low = F.struct("value", "index")
    high = F.struct(F.col("value"), (-F.col("index")).alias("index"))
    found = rows.groupBy(*keys).agg(
        F.max_by("period", high).alias("peak_period"),
        F.max("value").alias("peak_value"),
        F.min_by("period", low).alias("trough_period"),
        F.min("value").alias("trough_value"),
        F.count("value").alias("periods"),
    )
    base = F.abs(F.when(F.col("trough_value") != 0, F.col("trough_value")).otherwise(F.col("peak_value")))
    spread = F.try_divide(F.col("peak_value") - F.col("trough_value"), base) * 100
    return found.where(
        (F.col("periods") >= MIN_SEASON_POINTS) & (F.col("peak_value") != F.col("trough_value"))
    ).withColumn("amplitude_pct", F.coalesce(spread, F.lit(0.0)))


def pareto(df: DataFrame, dimension: str, measure: str, share: float = PARETO_SHARE, keep: int = PARETO_ITEMS) -> DataFrame:
    """The ``keep`` largest groups with their cumulative share, and how many groups make up ``share``.

    Groups of equal value are one row with their number; where the share is reached among them
    is arithmetic, so a value that very many groups have is no task of its own. Running totals
    are taken inside value buckets, so any number of distinct values can be ranked.
    """
    groups = settle(  # the table itself is read once
        df.groupBy(F.col(dimension).cast("string").alias("dimension"))
        .agg(F.sum(F.col(measure).cast("double")).alias("value"))
        .where(F.col("dimension").isNotNull() & F.col("value").isNotNull())
    )
    whole = groups.agg(
        F.sum("value").alias("total"), F.count(F.lit(1)).alias("groups"), cut_sketch(F.col("value")).alias("cuts")
    ).first()
    if not whole["total"]:
        return groups.select(
            "dimension", "value", F.lit(None).cast("double").alias("cumulative_share"),
            F.lit(0).cast("bigint").alias("cutoff_count"), F.lit(0).cast("bigint").alias("groups"),
            F.lit(0).alias("rank"),
        ).where(F.lit(False))
    tied = groups.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.col("value") * F.col("n"))
    running = running_total(tied, "value", "weight", "upto", clean_cuts(whole["cuts"]))
    # the k-th of n equal groups brings the sum to before + k * value; how many of them stay below the share?
    before, step = F.col("upto") - F.col("weight"), F.col("value") / F.lit(whole["total"])
    turn = F.try_divide(F.lit(share * whole["total"]) - before, F.col("value"))
    within = lambda k: F.greatest(F.lit(0), F.least(F.col("n"), k.cast("bigint")))
    below = (F.when(step > 0, within(F.ceil(turn) - 1)).when(step < 0, F.col("n") - within(F.floor(turn)))
             .otherwise(F.when(before / F.lit(whole["total"]) < share, F.col("n")).otherwise(0)))
    cutoff = running.agg((F.coalesce(F.sum(below), F.lit(0)) + 1).alias("n")).first()["n"]
    top = groups.orderBy(F.col("value").desc(), "dimension").limit(keep)
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("value").desc(), "dimension")  # keep rows
    upto = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return top.select(
        "dimension", "value", (upto / F.lit(whole["total"])).alias("cumulative_share"),
        F.lit(cutoff).alias("cutoff_count"), F.lit(whole["groups"]).alias("groups"),
        F.row_number().over(order).alias("rank"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left, right, rows, left_ss, right_ss, cross, broken) of every pair of columns, over rows where both are present.

    One reading of the rows: each task keeps one square matrix of counts, sums and products of all
    columns, less a task's own shift, and gives back a row per pair at its end. Rows of the tasks
    are put together by their means, so that a large common offset costs no digits. ``broken``
    counts rows whose value is not a finite number.
    """
    names, width = list(columns), len(columns)
    schema = "a int, b int, n double, mean_a double, mean_b double, ss_a double, ss_b double, cross double, broken double"

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, sums = None, np.zeros((5, width, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, MOMENT_ROWS):
                part = batch.slice(lo, MOMENT_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                there = np.column_stack([np.asarray(c.is_valid()) for c in part.columns])
                odd = there & ~np.isfinite(x)
                x[~there | odd] = 0.0
                if shift is None:  # a value of the column itself, so that a constant column is all zeros
                    shift = x[np.argmax(there & ~odd, axis=0), np.arange(width)]
                x = np.where(there & ~odd, x - shift, 0.0)
                has, bad = there.astype(float), odd.astype(float)
                one = bad.T @ has
                sums += [has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x, one + one.T]
        if shift is None:
            return
        a, b = np.triu_indices(width, 1)
        n, sa, sb, ssa, ssb = sums[0][a, b], sums[1][a, b], sums[1][b, a], sums[2][a, b], sums[2][b, a]
        safe = np.maximum(n, 1)
        out = [a.astype(np.int32), b.astype(np.int32), n, shift[a] + sa / safe, shift[b] + sb / safe,
               ssa - sa * sa / safe, ssb - sb * sb / safe, sums[3][a, b] - sa * sb / safe, sums[4][a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=[f.split()[0] for f in schema.split(", ")])

    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    pair = Window.partitionBy("a", "b")  # a row per task
    apart = doubles.mapInArrow(moments, schema).where("n > 0").select(
        "*", *[(F.col(f"mean_{c}") - F.max(f"mean_{c}").over(pair)).alias(f"d{c}") for c in "ab"])
    n, da, db = F.col("n"), F.col("da"), F.col("db")
    whole = lambda inner, x, y: F.sum(F.col(inner) + n * x * y) - F.sum(n * x) * F.sum(n * y) / F.sum(n)
    label = F.array(*[F.lit(c) for c in names])
    return apart.groupBy("a", "b").agg(
        F.sum(n).cast("bigint").alias("rows"), whole("ss_a", da, da).alias("left_ss"), whole("ss_b", db, db).alias("right_ss"),
        whole("cross", da, db).alias("cross"), F.sum("broken").cast("bigint").alias("broken"),
    ).select(label[F.col("a")].alias("left"), label[F.col("b")].alias("right"), "rows", "left_ss", "right_ss", "cross", "broken")


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, keep: int = KEPT_PAIRS) -> DataFrame:
    """Pearson r of every pair of numeric columns over rows where both are present.

    A pair with a column that is constant, or with a value that is no finite number, has none.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    r = F.try_divide(F.col("cross"), F.sqrt("left_ss") * F.sqrt("right_ss"))
    return (
        co_moments(df, columns)
        .where((F.col("rows") >= MIN_PAIR_ROWS) & (F.col("broken") == 0) & (F.col("left_ss") > 0) & (F.col("right_ss") > 0))
        .select("left", "right", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("correlation"), "rows")
        .where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
        .orderBy(F.round(F.abs("correlation"), 12).desc(), "left", "right")  # rounding noise is no rank
        .limit(keep)
    )


def row_concentration(df: DataFrame, dimension: str) -> DataFrame:
    """The most frequent value, its share of rows, and the number of distinct values."""
    counts = (
        df.where(F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).cast("string").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))
    return counts.agg(
        F.lit(dimension).alias("dimension"), top.alias("top_value"),
        (F.max("n") / F.sum("n")).alias("share"), F.count(F.lit(1)).alias("distinct_values"),
    ).where(F.col("distinct_values") > 0)
