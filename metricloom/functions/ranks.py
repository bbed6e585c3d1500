"""Exact quantiles and running totals that never put a whole column in one task.

Both work the same way. Cut points split the values: equal parts of the range, or up to ``CUTS``
points of a bounded sketch. They only split the work: whatever they are, each value falls into one bucket,
buckets are ordered, and the totals per bucket (a handful of rows) tell which bucket holds a
rank or which offset a bucket starts from. Rows are then ordered inside a bucket only. A bucket that a
rank is looked for in is cut again, by a sketch of its own, until it holds at most ``BUCKET_ROWS``
rows, so that what one task orders does not grow with the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.session import kept, settle

CUTS = 255
SKETCH_ACCURACY = 2000
#: Rows of a bucket that one task orders; larger ones are cut again.
BUCKET_ROWS = 1 << 20


def cut_sketch(value: Column) -> Column:
    """Mergeable aggregate of fixed size: approximate quantiles to cut a value range by."""
    probs = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    return F.percentile_approx(value.cast("double"), probs, SKETCH_ACCURACY)


def clean_cuts(cuts: Sequence[float] | None) -> list[float]:
    """Distinct finite cut points, filled up with infinity to a fixed length."""
    found = sorted({float(c) for c in cuts or [] if c is not None and abs(c) < float("inf")})
    return found + [float("inf")] * (CUTS - len(found))


def with_bucket(df: DataFrame, value: str, cuts: Column | Sequence[float], into: str = "_bucket") -> DataFrame:
    """Add the number of cut points at or below a value, by halving the list of cuts.

    One projection per halving: each step is computed once, where a single expression would
    repeat every earlier step.
    """
    points = cuts if isinstance(cuts, Column) else F.lit([float(c) for c in cuts])
    df, step = df.withColumn(into, F.lit(0)), (CUTS + 1) // 2
    while step:
        above = F.get(points, F.col(into) + (step - 1)) <= F.col(value)
        df = df.withColumn(into, F.col(into) + F.when(above, step).otherwise(0))
        step //= 2
    return df


def exact_quantiles(
    placed: DataFrame,
    keys: Sequence[str],
    probs: dict[str, float],
    method: str = "linear",
    few_keys: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Quantiles per key out of ``keys + (value, n, _bucket)`` rows, one output column per prob.

    ``linear`` interpolates between neighbours. ``nearest`` returns an observed value, the one
    at rank ``floor((n - 1) * q + 0.5) + 1``. ``few_keys`` says that keys are bounded (columns
    of a table), so the buckets to look into, at most two per key and prob, can be broadcast;
    otherwise their size decides. ``rows`` tells how many rows a key has at most, if that is known:
    then no job is needed to see that no bucket can be too large.
    """
    keys = list(keys)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy(*keys, "_bucket")
        .agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_rows").over(by_key))
    )
    wanted = []
    for name, q in probs.items():
        place = (F.col("_total") - 1) * F.lit(float(q))
        if method == "nearest":
            low = high = F.floor(place + 0.5) + 1
        else:
            low, high = F.floor(place) + 1, F.ceil(place) + 1
        for end, rank in (("low", low), ("high", high)):
            wanted.append(
                F.struct(
                    F.lit(name).alias("name"),
                    F.lit(end).alias("end"),
                    (rank - F.col("_before")).cast("bigint").alias("rank"),
                    (place - F.floor(place)).alias("part"),
                    ((rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_rows"))).alias("here"),
                )
            )
    wanted_here = (
        totals.withColumn("_wanted", F.filter(F.array(*wanted), lambda w: w["here"]))
        .where(F.size("_wanted") > 0)
        .select(*keys, "_bucket", "_size", "_wanted")
    )
    if few_keys:
        wanted_here = F.broadcast(wanted_here)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("value")
    held = placed.join(wanted_here, [*keys, "_bucket"])
    if rows is None or rows > BUCKET_ROWS:
        held = narrowed(held, keys)
    ranked = (
        held.withColumn("_upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*keys, "value", "n", "_upto", F.explode("_wanted").alias("_w"))
        .where((F.col("_w.rank") <= F.col("_upto")) & (F.col("_w.rank") > F.col("_upto") - F.col("n")))
    )
    outputs = []
    for name in probs:
        mine = F.col("_w.name") == name
        low = F.max(F.when(mine & (F.col("_w.end") == "low"), F.col("value").cast("double")))
        high = F.max(F.when(mine & (F.col("_w.end") == "high"), F.col("value").cast("double")))
        part = F.max(F.when(mine, F.col("_w.part")))
        value = low if method == "nearest" else low + (high - low) * part
        outputs.append(value.alias(name))
    return ranked.groupBy(*keys).agg(*outputs) if keys else ranked.agg(*outputs)


def narrowed(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of buckets that ranks are looked for in, cut again until no bucket has more than BUCKET_ROWS.

    ``held`` has ``keys + (_bucket, value, n, _size, _wanted)``: the rows of the bucket and the
    ranks wanted in it. A round writes what is left, at most two parts in CUTS of a bucket for
    each rank. Values that no cut tells apart are equal as doubles and stay together.
    """
    group, before_size = [*keys, "_bucket"], None
    held = settle(held.withColumn("_bucket", F.col("_bucket").cast("bigint")))
    while True:
        size = held.agg(F.max("_size").alias("m")).first()["m"] or 0
        if size <= BUCKET_ROWS or size == before_size:
            return held
        before_size = size
        cuts = held.where(F.col("_size") > BUCKET_ROWS).groupBy(*group).agg(cut_sketch(F.col("value")).alias("_cuts"))
        placed = with_bucket(held.drop("_size").join(cuts, group, "left"), "value", F.col("_cuts"), "_sub").drop("_cuts")
        before = Window.partitionBy(*group).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
        totals = (
            placed.groupBy(*group, "_sub")
            .agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_size"))
            .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        )
        here = F.filter("_wanted", lambda w: (w["rank"] > F.col("_before")) & (w["rank"] <= F.col("_before") + F.col("_rows")))
        moved = F.transform(here, lambda w: w.withField("rank", (w["rank"] - F.col("_before")).cast("bigint")))
        held = settle(
            placed.join(totals, [*group, "_sub"])
            .withColumn("_wanted", moved)
            .where(F.size("_wanted") > 0)
            .withColumn("_bucket", F.col("_bucket") * (CUTS + 1) + F.col("_sub"))
            .select(*keys, "_bucket", "value", "n", "_size", "_wanted")
        )


def by_width(counts: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Counted values with ``_bucket``, one of CUTS + 1 equal parts of their key's range, and the rows of the largest key.

    Keys are few, such as the columns of a table: a small row for each is brought back. Parts of
    a skewed range may be very unequal; those that matter are cut again.
    """
    value = F.col("value")
    ranges = kept(counts.groupBy(key).agg(
        F.min(F.when(value * 0 == 0, value)).alias("_low"), F.max(F.when(value * 0 == 0, value)).alias("_high"), F.count(F.lit(1)).alias("_most")))
    bucket = (F.when(value >= F.col("_high"), CUTS + 2).when(value <= F.col("_low"), 0)
              .otherwise(F.coalesce(F.width_bucket(value, "_low", "_high", F.lit(CUTS + 1)), F.lit(0))))
    placed = counts.join(F.broadcast(ranges), key).withColumn("_bucket", bucket).drop("_low", "_high", "_most")
    return placed, max((r["_most"] for r in ranges.collect()), default=0)


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], prob: float, method: str = "linear"
) -> DataFrame:
    """One exact quantile of each of several expressions per group, straight from rows: a column per expression.

    All expressions are counted together, ``keys + (which, value) -> n``, in one reading of the
    rows, and the counts are written: ranges and ranks both use them.
    """
    which = [F.struct(F.lit(i).alias("_which"), v.cast("double").alias("value")) for i, v in enumerate(values.values())]
    rows = df.select(*keys, F.inline(F.array(*which))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = settle(rows.groupBy(*keys, "_which", "value").agg(F.count(F.lit(1)).alias("n")))
    placed, most = by_width(counts, "_which")
    one = exact_quantiles(placed, [*keys, "_which"], {"q": prob}, method, rows=most)
    columns = [F.max(F.when(F.col("_which") == i, F.col("q"))).alias(name) for i, name in enumerate(values)]
    return one.groupBy(*keys).agg(*columns) if keys else one.agg(*columns)


def running_total(df: DataFrame, value: str, weight: str, into: str, cuts: Sequence[float]) -> DataFrame:
    """Running sum of ``weight`` from the largest ``value`` down, over any number of rows with distinct values."""
    placed = with_bucket(df, value, cuts).withColumn("_bucket", -F.col("_bucket"))
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = (
        placed.groupBy("_bucket")
        .agg(F.sum(weight).alias("_sum"))
        .select("_bucket", F.coalesce(F.sum("_sum").over(order), F.lit(0.0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(offsets, "_bucket")
        .withColumn(into, F.col("_offset") + F.sum(weight).over(inside))
        .drop("_bucket", "_offset")
    )
