"""Column and table profiles.

A profile reads the table in two ways. One wide aggregation takes everything that merges in
fixed space (counts, moments, ranges). Distinct counts, least values and quartiles of whole,
floating and temporal columns come from sorted blocks of values (see ``numbers``), outliers from
one more reading. Texts and decimals are counted in long form, ``(column, value) -> n``; what a
profile says of them comes from those counts, so that a regular expression sees each distinct
text once. Decimals are counted in their own type, so that all their digits tell them apart; long
texts by fingerprint (see ``counts``).
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import fixed_values as fixed
from metricloom.functions.ranks import by_width, exact_quantiles
from metricloom.functions.text import contains_any, finite, is_padded
from metricloom.operators.counts import SHORT, TextCounts, count_texts, holds, like_mail
from metricloom.operators.numbers import summarise
from metricloom.session import kept, settle, together

# Fixed values
TOP_VALUES, SAMPLE_VALUES, IQR_REACH = 10, 5, 1.5
SCANNED_COLUMNS = 20
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
GRANULARITY = [("hour_or_finer", 1, False), ("day", 2, True), ("week", 10, True), ("month", 40, True)]

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

PASS_ONE = """column_name string, position int, inferred_type string, kind string, row_count bigint,
null_count bigint, value_count bigint, mean double, std double, min double, max double,
negative_count bigint, min_date string, max_date string"""


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    return "temporal" if isinstance(dtype, TEMPORAL) else "other"


def family_of(dtype: T.DataType) -> str:
    """The common type a column's values are counted in; times count as microseconds, each decimal type is its own."""
    if isinstance(dtype, (*INTEGRAL, *TEMPORAL)):
        return "bigint"
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    return {"numeric": "double", "other": "string"}[kind_of(dtype)]


def _counted(df: DataFrame, column: str, family: str) -> Column:
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, TEMPORAL):
        c = F.unix_micros(c.cast("timestamp"))
    return c.cast(family).alias(column)


def _scan(df: DataFrame) -> list[tuple]:
    """The wide aggregation: one row back, turned into one record per column.

    Very wide tables take one aggregation per ``SCANNED_COLUMNS``, so that the generated code
    stays small enough to be compiled well.
    """
    fields, row = list(enumerate(df.schema)), {}
    for start in range(0, len(fields), SCANNED_COLUMNS):
        row.update(df.agg(*_wide(fields[start:start + SCANNED_COLUMNS])).first().asDict())
    records = []
    for i, f in fields:
        get = lambda stat: row.get(f"{stat}{i}")
        records.append((f.name, i, f.dataType.simpleString(), kind_of(f.dataType), row["rows"],
                        row["rows"] - get("n"), get("n"), get("mean"), get("std"), get("min"), get("max"),
                        get("neg"), get("from"), get("to")))
    return records


def _wide(fields: list[tuple[int, T.StructField]]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in fields:
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        aggs.append(F.count(c).alias(f"n{i}"))
        if kind == "numeric":
            d = c.cast("double")
            aggs += [finite(F.avg(d)).alias(f"mean{i}"), finite(F.stddev_samp(d)).alias(f"std{i}"),
                     finite(F.min(d)).alias(f"min{i}"), finite(F.max(d)).alias(f"max{i}"),
                     F.count_if(d < 0).alias(f"neg{i}")]
        elif kind == "temporal":
            aggs += [F.min(c).cast("string").alias(f"from{i}"), F.max(c).cast("string").alias(f"to{i}")]
    return aggs


def _scan_numbers(df: DataFrame, columns: list[str], times: list[str]) -> tuple[list[tuple], list[DataFrame]]:
    """The wide aggregation, and what is known of whole, floating and temporal columns, a row each."""
    records = _scan(df)
    if not columns:
        return records, []
    typed = df.select(*[_counted(df, c, family_of(df.schema[c].dataType)) for c in columns])
    found = summarise(typed, records[0][4], SAMPLE_VALUES, QUARTILES, [c for c in columns if c not in times])
    outside = _outside(typed, {c: f for c, f in found.items() if f["q25"] is not None and f["q75"] > f["q25"]})
    rows = [(c, f["distinct"], None if family_of(df.schema[c].dataType) == "double" else f["least"],
             f["least"] if family_of(df.schema[c].dataType) == "double" else None, c in times, *[f[q] for q in QUARTILES], outside.get(c))
            for c, f in found.items() if f["distinct"]]
    schema = ("column_name string, distinct_values bigint, whole array<bigint>, floating array<double>, time boolean, "
              + ", ".join(f"{q} double" for q in QUARTILES) + ", outlier_count_iqr bigint")
    moments = F.transform("whole", lambda v: F.timestamp_micros(v).cast("timestamp_ntz").cast("string"))
    shown = F.when(F.col("time"), moments).otherwise(F.coalesce(F.col("whole").cast("array<string>"), F.col("floating").cast("array<string>")))
    local = df.sparkSession.createDataFrame(rows, schema)
    return records, [local.withColumn("sample_values", shown).drop("whole", "floating", "time")]


def _outside(df: DataFrame, quartiles: dict[str, dict]) -> dict[str, int]:
    """Rows beyond 1.5 interquartile ranges of each column, in one reading of the rows."""
    names, found = list(quartiles), {}
    for start in range(0, len(names), SCANNED_COLUMNS):
        aggs = []
        for i, name in enumerate(names[start:start + SCANNED_COLUMNS]):
            q25, q75 = quartiles[name]["q25"], quartiles[name]["q75"]
            value, reach = F.col(f"`{name}`").cast("double"), (q75 - q25) * IQR_REACH
            aggs.append(F.count_if(~F.isnan(value) & ((value < q25 - reach) | (value > q75 + reach))).alias(f"o{i}"))
        found.update(zip(names[start:], df.agg(*aggs).first()))  # noqa: B905: the row ends with its chunk
    return found


def value_counts(df: DataFrame, columns: list[str], family: str) -> DataFrame:
    """``(column_name, value, n)`` of non-null values, all columns of a family in one shuffle."""
    return _long(df, columns, family).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _long(df: DataFrame, columns: list[str], family: str) -> DataFrame:
    typed = df.select(*[_counted(df, c, family) for c in columns])
    return typed.unpivot([], [f"`{c}`" for c in columns], "column_name", "value").where(F.col("value").isNotNull())


def _text_facts(texts: TextCounts) -> list[DataFrame]:
    """Distinct texts; white space at the edges, empty text and e-mail shape, weighted by how often a text occurs."""
    n, padded = F.col("n"), holds("padded")
    facts = texts.rows.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum(F.when(padded, n).otherwise(0)).alias("whitespace_count"),
        F.sum(F.when(F.col("value") == "", n).otherwise(0)).alias("empty_count"),
        (F.sum(F.when(holds("mail"), n).otherwise(0)) / F.sum("n")).alias("email_share"),
    )
    # the least text of a group is found by sorting: only padded ones are
    around = replace(texts, rows=texts.rows.where(padded))
    if texts.long:
        return [facts, around.first(1).select("column_name", F.col("value").alias("whitespace_example"))]
    return [facts, around.rows.groupBy("column_name").agg(F.min("value").alias("whitespace_example"))]


def _top(texts: TextCounts) -> DataFrame:
    return (
        texts.first(TOP_VALUES, F.col("n").desc())
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value", F.col("n").alias("count")))).alias("t"))
        .select("column_name", F.transform("t", lambda e: F.struct(e["value"], e["count"])).alias("top_values"))
    )


def _samples(first: DataFrame, shown: Column) -> DataFrame:
    """The first values of each column by ``place``."""
    return (
        first.groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("place", shown.alias("v")))).alias("t"))
        .select("column_name", F.col("t.v").alias("sample_values"))
    )


def _first_values(counts: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    return _samples(counts.withColumn("place", place).where(F.col("place") <= SAMPLE_VALUES), F.col("value").cast("string"))


def date_granularity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Typical step between consecutive times, from whole-day gaps.

    Gaps inside one calendar day are zero whole days, so counts, first and last time per day
    carry all that is needed: days are ordered, never the rows.
    """
    typed = df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) for c in columns])
    long = typed.unpivot([], [f"`{c}`" for c in columns], "column_name", "t").where(F.col("t").isNotNull())
    days = long.groupBy("column_name", F.to_date("t").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")
    )
    previous = F.lag("last").over(Window.partitionBy("column_name").orderBy("day"))
    gaps = days.select("column_name", "n", "first", previous.alias("previous"))
    steps = gaps.select(
        "column_name",
        F.inline(F.array(
            F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("n") - 1).alias("times")),
            F.struct(F.timestamp_diff("DAY", F.col("previous"), F.col("first")).alias("gap"),
                     F.lit(1).cast("bigint").alias("times")),
        )),
    ).where(F.col("gap").isNotNull() & (F.col("times") > 0))
    spread = steps.groupBy("column_name").agg(
        F.sum("times").alias("gaps"), F.percentile("gap", F.lit(0.5), F.col("times")).alias("median_gap")
    )
    label = F.when(F.col("gaps") < 2, "unknown")
    for name, limit, inclusive in GRANULARITY:
        within = F.col("median_gap") <= limit if inclusive else F.col("median_gap") < limit
        label = label.when(within, name)
    return spread.select("column_name", label.otherwise("year").alias("granularity"))


def logical_type(mode: str = "substring") -> Column:
    """Meaning of a column out of its name, storage kind and distinct count.

    ``mode="token"`` matches hints against whole words of the name, so that ``discount`` is
    not read as a count; the default matches anywhere in the name.
    """
    name = F.lower("column_name")

    def hinted(words):
        if mode == "token":
            return name.rlike(r"(^|[^a-z0-9])(" + "|".join(words) + r")([^a-z0-9]|$)")
        return contains_any(name, words)

    rows, distinct = F.col("row_count"), F.col("distinct_count")
    numeric = F.col("kind") == "numeric"
    return (
        F.when(hinted(fixed.DATE_HINTS) | (F.col("kind") == "temporal"), "datetime")
        .when(numeric & hinted(fixed.MONEY_HINTS), "currency")
        .when(numeric & hinted(fixed.QTY_HINTS), "quantity")
        .when(numeric & hinted(fixed.ID_HINTS)
              & (distinct >= F.greatest(F.lit(1), F.floor(rows * 0.9))), "identifier")
        .when(numeric, "numeric")
        .when(hinted(fixed.GEO_HINTS), "geo")
        .when((distinct > 0) & (distinct <= F.greatest(F.lit(20), F.floor(rows * 0.05))), "categorical")
        .when(hinted(fixed.ID_HINTS), "identifier")
        .when(F.col("email_share") >= 0.5, "email")
        .otherwise("text")
    )


def semantic_hint() -> Column:
    name, kind = F.lower("column_name"), F.col("logical_type")
    by_type = {"currency": "measure.revenue_like", "quantity": "measure.quantity", "datetime": "dimension.time",
               "geo": "dimension.geo", "categorical": "dimension.category", "identifier": "identifier"}
    hint = reduce(lambda h, kv: h.when(kind == kv[0], kv[1]), by_type.items(), F.when(F.lit(False), ""))
    for word, label in (("status", "dimension.status"), ("customer", "entity.customer"),
                        ("product", "entity.product"), ("order", "entity.order")):
        hint = hint.when(name.contains(word), label)
    return hint.otherwise(kind)


def profile_columns(
    df: DataFrame, name: str, hint_mode: str = "substring", approximate: bool = False, texts: TextCounts | None = None,
) -> DataFrame:
    """One row per column. ``approximate`` swaps the value counts for sketches on huge tables.

    ``texts`` are the counted texts of the table's text columns, if they have been counted before.
    """
    spark = df.sparkSession
    families: dict[str, list[str]] = {}
    for f in df.schema:
        families.setdefault(family_of(f.dataType), []).append(f.name)
    times = [f.name for f in df.schema if kind_of(f.dataType) == "temporal"]
    others = families.pop("string", [])

    if approximate:
        facts = [spark.createDataFrame(_scan(df), PASS_ONE), *_sketched(df)]
        if others:
            facts.append(_text_shares(df, others))
    else:
        count = (lambda: texts) if texts is not None or not others else (lambda: count_texts(df, others))
        plain = [f.name for f in df.schema if family_of(f.dataType) in ("bigint", "double")]
        exact = {family: columns for family, columns in families.items() if family not in ("bigint", "double")}
        jobs = [lambda f=family, c=columns: settle(value_counts(df, c, f)) for family, columns in exact.items()]
        (records, of_plain), texts, *settled = together(lambda: _scan_numbers(df, plain, times), count, *jobs)
        facts = [spark.createDataFrame(records, PASS_ONE), *of_plain]
        distinct = lambda table: table.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
        for table in settled:
            facts += [distinct(table), _first_values(table)]
        if others:
            facts += [_samples(texts.first(SAMPLE_VALUES), F.col("value")), _top(texts), *_text_facts(texts)]
        if settled:
            numbers = reduce(DataFrame.unionByName, [
                t.select("column_name", F.col("value").cast("double").alias("value"), "n") for t in settled])
            quartiles = _quartiles(numbers)
            facts += [quartiles, _outliers(numbers, quartiles)]
    if times:
        facts.append(date_granularity(df, times))

    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    merged = merged.groupBy("column_name").agg(
        *[F.max(c).alias(c) for c in merged.columns if c != "column_name"]
    )
    for column, dtype in {"top_values": "array<struct<value:string,count:bigint>>", "sample_values": "array<string>", "granularity": "string",
                          **{q: "double" for q in QUARTILES}, "outlier_count_iqr": "bigint", "email_share": "double",
                          "whitespace_count": "bigint", "whitespace_example": "string", "empty_count": "bigint"}.items():
        if column not in merged.columns:
            merged = merged.withColumn(column, F.lit(None).cast(dtype))
    return _describe(merged, name, hint_mode)


def _quartiles(numbers: DataFrame) -> DataFrame:
    """Quartiles of each column, a row of fixed size per column."""
    placed, most = by_width(numbers, "column_name")
    return kept(exact_quantiles(placed, ["column_name"], QUARTILES, "nearest", few_keys=True, rows=most))


def _outliers(numbers: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges. The bounds are one row per column."""
    reach = (F.col("q75") - F.col("q25")) * IQR_REACH
    bounds = quartiles.where(F.col("q75") > F.col("q25")).select(
        "column_name", (F.col("q25") - reach).alias("_low"), (F.col("q75") + reach).alias("_high")
    )
    outside = (F.col("value") < F.col("_low")) | (F.col("value") > F.col("_high"))
    return numbers.join(F.broadcast(bounds), "column_name").groupBy("column_name").agg(
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count_iqr")
    )


def _sketched(df: DataFrame) -> list[DataFrame]:
    """Distinct counts, quartiles, frequent and least values from mergeable sketches, in one pass."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs += [F.approx_count_distinct(c).alias(f"d{i}"), F.min(c.cast("string")).alias(f"s{i}")]
        numeric = kind_of(f.dataType) == "numeric"
        quart = F.percentile_approx(c.cast("double"), list(QUARTILES.values()), 10000) if numeric else F.lit(None).cast("array<double>")
        aggs.append((quart if numeric else F.first(quart)).alias(f"q{i}"))
        text = kind_of(f.dataType) == "other"
        frequent = F.expr(f"approx_top_k(left(cast(`{f.name}` as string), {SHORT}), {TOP_VALUES})") if text else F.lit(None).cast("array<struct<item:string,count:bigint>>")
        aggs.append((frequent if text else F.first(frequent)).alias(f"t{i}"))
        top = F.transform(F.filter(F.col(f"t{i}"), lambda e: e["item"].isNotNull()), lambda e: F.struct(e["item"].alias("value"), e["count"].alias("count")))
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.col(f"d{i}").alias("distinct_values"), top.alias("top_values"),
                             F.when(F.col(f"s{i}").isNotNull(), F.array(F.col(f"s{i}"))).alias("sample_values"),
                             *[F.col(f"q{i}")[j].alias(q) for j, q in enumerate(QUARTILES)]))
    return [df.agg(*aggs).select(F.inline(F.array(*rows)))]


def _text_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """The facts of ``_text_facts`` straight from rows."""
    value, padded = F.col("value"), is_padded(F.col("value"))
    return _long(df, columns, "string").groupBy("column_name").agg(
        F.count_if(padded).alias("whitespace_count"), F.min(F.when(padded, value)).alias("whitespace_example"),
        F.count_if(value == "").alias("empty_count"), F.avg(like_mail(value).cast("int")).alias("email_share"))


def _describe(merged: DataFrame, name: str, hint_mode: str) -> DataFrame:
    rows = F.col("row_count")
    share = lambda part: F.coalesce(F.try_divide(part * F.lit(100.0), rows), F.lit(0.0))
    lowered = F.lower("column_name")
    typed = (
        merged.withColumn("table_name", F.lit(name))
        .withColumn("distinct_count", F.coalesce("distinct_values", F.lit(0)) + (F.col("null_count") > 0).cast("int"))
        .withColumn("_null_pct", share(F.col("null_count")))
        .withColumn("_unique_pct", share(F.col("distinct_count")))
        .withColumn("logical_type", logical_type(hint_mode))
        .withColumn("semantic_hint", semantic_hint())
        .withColumn("is_candidate_pk", (F.col("_unique_pct") >= 99.5) & (F.col("null_count") == 0) & (rows > 0))
        .withColumn(
            "is_candidate_fk",
            (lowered.contains("id") | lowered.endswith("_fk")) & ~F.col("is_candidate_pk") & (F.col("_unique_pct") >= 1),
        )
    )
    outlier_share = F.try_divide(F.col("outlier_count_iqr"), F.col("value_count"))
    warnings = F.array_compact(F.array(
        F.when(outlier_share > 0.05, "High outlier rate by IQR"),
        F.when((F.col("min") < 0) & lowered.contains("id"), "Negative values in identifier-like column"),
        F.when(F.col("_null_pct") > 40, "High missingness"),
        F.when((F.col("_unique_pct") == 100) & (rows > 1) & (F.col("logical_type") == "text"),
               "All values unique — possible identifier"),
    ))
    numeric = F.col("kind") == "numeric"
    return typed.select(
        "table_name", "column_name", "position", "inferred_type", "kind", "logical_type", "semantic_hint",
        "row_count", "null_count", F.round("_null_pct", 4).alias("null_pct"), "distinct_count",
        F.round("_unique_pct", 4).alias("uniqueness_pct"), "is_candidate_pk", "is_candidate_fk",
        F.when(numeric, F.col("value_count")).alias("value_count"), "mean", "std", "min", "max",
        "q25", "q50", "q75", F.col("q50").alias("median"), "outlier_count_iqr", "negative_count",
        "min_date", "max_date", "granularity", "top_values", "sample_values",
        "whitespace_count", "whitespace_example", "empty_count", warnings.alias("warnings"),
    )


def _hash_of(df: DataFrame) -> Column:
    """64 bits of a whole row; equal rows have equal ones."""
    return F.xxhash64(*[
        (F.col(f"`{f.name}`") + F.lit(0.0)).cast(f.dataType) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def _repeats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by hash, and the distinct rows that occur more than once with their number ``_n``.

    The full shuffle moves eight bytes a row. Only rows whose hash repeats are then compared in
    full, so hash collisions cannot miscount.
    """
    hashed = df.withColumn("_hash", _hash_of(df))
    by_hash = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    suspects = hashed.join(by_hash.where(F.col("_n") > 1).select("_hash"), "_hash", "left_semi")
    same = suspects.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return by_hash, same.where(F.col("_n") > 1)


def repeated_rows(df: DataFrame) -> DataFrame:
    """The distinct rows that occur more than once, and how often as ``_n``."""
    return _repeats(df)[1]


def duplicate_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows, and rows that repeat an earlier one exactly: ``(table_name, row_count, duplicate_row_count)``."""
    by_hash, same = _repeats(df)
    counted = by_hash.agg(F.sum("_n").alias("row_count")).unionByName(
        same.agg(F.sum(F.col("_n") - 1).alias("duplicate_row_count")), allowMissingColumns=True
    )
    return counted.agg(
        F.lit(name).alias("table_name"),
        F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.max("duplicate_row_count"), F.lit(0)).alias("duplicate_row_count"),
    )


def profile_tables(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row per table: size, duplicates, score and warnings."""
    per_table = columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("column_count"), F.avg("null_pct").alias("_null_pct"),
        F.sum("null_count").alias("null_cells"),
    )
    joined = duplicates.join(per_table, "table_name")
    repeated = F.least(F.lit(100.0), F.coalesce(F.try_divide(F.col("duplicate_row_count") * 100.0, F.col("row_count")), F.lit(0.0)))
    warnings = F.array_compact(F.array(
        F.when(F.col("row_count") == 0, "Table is empty"),
        F.when(F.col("duplicate_row_count") > 0,
               F.concat(F.col("duplicate_row_count").cast("string"), F.lit(" duplicate rows detected"))),
    ))
    return joined.select(
        "table_name", "row_count", "column_count", "duplicate_row_count", "null_cells",
        F.round((100 - F.col("_null_pct")) * 0.6 + (100 - repeated) * 0.4, 2).alias("quality_score"),
        warnings.alias("warnings"),
    )


def profile_summary(columns: DataFrame) -> DataFrame:
    """Mean null rate, columns worth a look, measures and dimensions, per table."""
    issue = (F.size("warnings") > 0) | (F.col("null_pct") > 5) | (F.coalesce("outlier_count_iqr", F.lit(0)) > 0)
    return columns.groupBy("table_name").agg(
        F.avg("null_pct").alias("mean_null_pct"),
        F.count_if(issue).alias("columns_with_issues"),
        F.count_if(F.col("logical_type").isin("currency", "quantity", "numeric")).alias("measures"),
    )


def top_value_share(columns: DataFrame) -> DataFrame:
    """Share of the most frequent value among the values kept, in percent."""
    total = F.aggregate("top_values", F.lit(0).cast("bigint"), lambda a, e: a + e["count"])
    return columns.where(F.size("top_values") > 0).select(
        "table_name", "column_name", F.col("top_values")[0]["value"].alias("top_value"),
        (F.try_divide(F.col("top_values")[0]["count"], total) * 100).alias("share_pct"),
    )
