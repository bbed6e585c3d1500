"""Counted texts: what inference, profiles and the search for personal data read in place of rows.

``(column_name, value, mark, facts, n)``, one row per distinct text of a column. A text of up to
SHORT bytes is its own value. Of a longer one the value is its first HEAD characters, ``mark`` a
fingerprint of 128 bits with its length, and ``facts`` the outcome of every test on texts, taken
from the whole text on the row itself; so what is shuffled does not grow with the length of
texts. Whole texts are fetched for those few that are shown.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom import fixed_values as fixed
from metricloom.functions.text import is_padded
from metricloom.session import settle

SHORT, HEAD = 128, 64
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
THIRD_PART = r"[-/.](?:\d{4}|\d{2}(?!\d))"
DAY_FIRST = r"^\s*(?:0?1[3-9]|0?[2-9]\d|[1-9]\d\d)[-/.]\d{1,2}" + THIRD_PART
MONTH_FIRST = r"^\s*\d{1,3}[-/.](?:1[3-9]|[2-9]\d)" + THIRD_PART
PHONE_DIGITS = 8  # fixed value


def parse_number(c: Column, stripped: bool = False) -> Column:
    text = F.regexp_replace(c, fixed.SEPARATORS, "") if stripped else c
    return F.when(text.rlike(NUMBER), text).try_cast("double")


def like_mail(c: Column) -> Column:
    return c.contains("@") & c.rlike(fixed.EMAIL)


def like_phone(c: Column) -> Column:
    return c.rlike(fixed.PHONE) & (F.length(F.regexp_replace(c, r"\D", "")) >= PHONE_DIGITS)


def like_uuid(c: Column) -> Column:
    return (F.length(c) == 36) & c.rlike(fixed.UUID)


TESTS: dict[str, Callable[[Column], Column]] = {
    "padded": is_padded,
    "mail": like_mail,
    "phone": like_phone,
    "uuid": like_uuid,
    "dates": lambda c: c.rlike(fixed.DATE_SHAPE),
    "numbers": lambda c: c.rlike(fixed.NUMBER_SHAPE),
    "zeros": lambda c: c.rlike(fixed.LEADING_ZERO),
    "plain": lambda c: parse_number(c).isNotNull(),
    "cleaned": lambda c: parse_number(c, stripped=True).isNotNull(),
    "day": lambda c: c.rlike(DAY_FIRST),
    "month": lambda c: c.rlike(MONTH_FIRST),
}


#: What a text must be made of to pass the costly tests on long texts; it fails at the first other character.
_NUMERIC = r"^[-+.,'\d\s eE]*$"


def _of_long(name: str, text: Column) -> Column:
    """A test of a text of more than SHORT bytes; telephone numbers and identifiers are never so long."""
    if name in ("phone", "uuid"):
        return F.lit(False)
    test = TESTS[name](text)
    return F.when(text.rlike(_NUMERIC), test).otherwise(False) if name in ("plain", "cleaned", "numbers") else test


def holds(name: str) -> Column:
    """Whether a counted text passes a test."""
    bit = F.col("facts").bitwiseAND(F.lit(1 << list(TESTS).index(name)).cast("bigint")) != 0
    return F.when(F.col("mark").isNull(), TESTS[name](F.col("value"))).otherwise(bit)


def _marked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, text, long, mark) of all values of text columns that are not null."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    rows = texts.unpivot([], [f"`{c}`" for c in columns], "column_name", "text").where(F.col("text").isNotNull())
    long = F.octet_length("text") > SHORT
    mark = F.concat(F.substring(F.unhex(F.sha2("text", 256)), 1, 16), F.unhex(F.lpad(F.hex(F.octet_length("text")), 8, "0")))
    return rows.select("column_name", "text", long.alias("long"), F.when(long, mark).alias("mark"))


@dataclass(frozen=True)
class TextCounts:
    """The counted texts of columns, the frame they come from, and the columns that hold long ones."""

    rows: DataFrame
    source: DataFrame
    long: frozenset[str]

    def only(self, columns: Sequence[str]) -> TextCounts:
        return replace(self, rows=self.rows.where(F.col("column_name").isin(list(columns))), long=self.long & set(columns))

    def shown(self, picked: DataFrame) -> DataFrame:
        """Picked rows with whole texts as ``value``; only columns with long texts are read again."""
        if not self.long:
            return picked
        wanted = picked.where("mark is not null").select("column_name", "mark").distinct()
        found = _marked(self.source, sorted(self.long)).where("long").join(wanted, ["column_name", "mark"], "left_semi")
        found = found.groupBy("column_name", "mark").agg(F.any_value("text").alias("_text"))
        return picked.join(found, ["column_name", "mark"], "left").withColumn("value", F.coalesce("_text", "value")).drop("_text")

    def first(self, most: int, *order: Column) -> DataFrame:
        """The first ``most`` texts of each column by ``order`` and then by text, with their ``place``."""
        head = F.left("value", F.lit(HEAD))
        within = lambda *by: Window.partitionBy("column_name").orderBy(*order, *by)
        # ties of the head are settled by whole texts
        near = self.rows.withColumn("_near", F.rank().over(within(head))).where(F.col("_near") <= most).drop("_near")
        return self.shown(near).withColumn("place", F.row_number().over(within("value"))).where(F.col("place") <= most)


def count_texts(df: DataFrame, columns: Sequence[str]) -> TextCounts:
    """Counted texts of columns, written: one shuffle for all of them, copies merged ahead of it."""
    bits = [F.when(_of_long(name, F.col("text")), F.lit(1 << i).cast("bigint")).otherwise(0) for i, name in enumerate(TESTS)]
    facts = bits[0]
    for bit in bits[1:]:
        facts = facts + bit
    rows = _marked(df, columns).select(
        "column_name", F.when(F.col("long"), F.left("text", F.lit(HEAD))).otherwise(F.col("text")).alias("value"),
        "mark", F.when(F.col("long"), facts).alias("facts"))
    counted = settle(rows.groupBy("column_name", "value", "mark", "facts").agg(F.count(F.lit(1)).alias("n")))
    long = counted.where("mark is not null").select("column_name").distinct().collect()
    return TextCounts(counted, df, frozenset(r["column_name"] for r in long))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
