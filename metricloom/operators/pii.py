"""Personal data: which columns look like it, and masking of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import fixed_values as fixed
from metricloom.functions.text import contains_any, mask_value
from metricloom.operators.counts import PHONE_DIGITS, TextCounts, count_texts, holds, like_phone, text_columns

ADVICE = "Keep raw values inside the cluster; share statistics and masked samples only."
MAJORITY = 0.5  # fixed value
#: Columns of one aggregation.
BLOCK = 40


def _seen_in(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, email, phone, uuid) of columns that are not text: digits may be a telephone number, nothing else.

    Whole numbers are judged by their size; other values by their text. ``BLOCK`` columns share an aggregation.
    """
    parts = []
    for start in range(0, len(columns), BLOCK):
        aggs, rows = [], []
        for i, name in enumerate(columns[start:start + BLOCK]):
            c, dtype = F.col(f"`{name}`"), df.schema[name].dataType
            whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
            phone = (F.abs(c.cast("decimal(20,0)")) >= 10 ** (PHONE_DIGITS - 1)) if whole else like_phone(c.cast("string"))
            aggs += [F.count(c).alias(f"n{i}"), F.count_if(phone).alias(f"p{i}")]
            rows.append(F.struct(F.lit(name).alias("column_name"), F.col(f"n{i}").alias("n"), F.lit(0).cast("bigint").alias("email"),
                                 F.col(f"p{i}").alias("phone"), F.lit(0).cast("bigint").alias("uuid")))
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def detect_pii(df: DataFrame, table: str, texts: TextCounts | None = None) -> DataFrame:
    """Columns flagged by name or by at least half of their values, over all rows.

    Texts are judged once each, by their counts (``texts``, if they have been counted before).
    """
    text = text_columns(df)
    others = [c for c in df.columns if c not in text]
    parts = []
    if text:
        filled = (texts or count_texts(df, text)).rows.where((F.col("value") != "") | F.col("mark").isNotNull())
        seen = lambda name: F.sum(F.when(holds(name), F.col("n")).otherwise(0))
        parts.append(filled.groupBy("column_name").agg(
            F.sum("n").alias("n"), seen("mail").alias("email"), seen("phone").alias("phone"), seen("uuid").alias("uuid")))
    if others:
        parts.append(_seen_in(df, others))
    shares = reduce(DataFrame.unionByName, parts).where(F.col("n") > 0).select(
        "column_name", *[(F.col(k) / F.col("n")).alias(k) for k in ("email", "phone", "uuid")])
    lowered = F.lower("column_name")
    rules = [  # fixed values: order, kinds and confidences
        (lowered.contains("email") | (F.col("email") >= MAJORITY), "email", 0.95),
        (contains_any(lowered, ("phone", "mobile")) | (F.col("phone") >= MAJORITY), "phone", 0.85),
        (contains_any(lowered, fixed.NAME_HINTS), "name", 0.7),
        (contains_any(lowered, fixed.ADDRESS_HINTS), "address", 0.7),
        (contains_any(lowered, fixed.NATIONAL_ID_HINTS), "national_id", 0.9),
        (F.col("uuid") >= MAJORITY, "identifier", 0.6),
    ]
    found = F.coalesce(*[
        F.when(test, F.struct(F.lit(kind).alias("pii_type"), F.lit(sure).alias("confidence")))
        for test, kind, sure in rules
    ])
    return shares.withColumn("found", found).where(F.col("found").isNotNull()).select(
        F.lit(table).alias("table_name"), "column_name", "found.pii_type", "found.confidence",
        F.lit(ADVICE).alias("action"),
    )


def mask_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Mask the given columns; ``kinds`` maps a column to its kind of personal data."""
    return df.withColumns({c: mask_value(F.col(c).cast("string"), kind) for c, kind in kinds.items()})
