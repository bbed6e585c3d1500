"""Column functions over text: edges, masking, wording of numbers, literal LIKE."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.fixed_values import WHITESPACE


def strip(c: Column) -> Column:
    """Drop Unicode white space from both ends (Spark's trim only drops spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_padded(c: Column) -> Column:
    return c != strip(c)


def like_literal(c: Column, pattern: str) -> Column:
    """LIKE where a backslash is a plain character, as in ANSI SQL without ESCAPE."""
    return c.like(pattern.replace("\\", "\\\\"))


def contains_any(c: Column, words) -> Column:
    """True when the text holds at least one of a fixed list of words."""
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def sanitize_name(name: str) -> str:
    """A view name out of any table name: letters, digits, underscore; never digit-led."""
    cleaned = re.sub("[^A-Za-z0-9_]", "_", name or "")
    return f"t_{cleaned}" if not cleaned or cleaned[0].isdigit() else cleaned


def finite(c: Column) -> Column:
    """Double, with NaN and infinities turned into null."""
    d = c.cast("double")
    return F.when(d * 0 == 0, d)  # zero times infinity is NaN, which equals only itself


def _pattern(c: Column, pattern: str) -> Column:
    """Decimal formatting that rounds the exact value, ties to even."""
    return F.call_function("format_number", c.cast("double"), F.lit(pattern))


def fixed_point(c: Column, decimals: int, signed: bool = False) -> Column:
    """A number with fixed decimals and no separators."""
    digits = "0." + "0" * decimals if decimals else "0"
    return _pattern(c, f"+{digits};-{digits}" if signed else digits)


def _four_significant(c: Column) -> Column:
    """Four significant digits without trailing zeros; exponent form below 1e-4."""
    sci = _pattern(F.abs(c), "0.000E0")
    exponent = F.substring_index(sci, "E", -1).try_cast("int")
    mantissa = F.regexp_replace(F.substring_index(sci, "E", 1), r"\.?0+$", "")
    digits = F.regexp_replace(mantissa, r"\.", "")
    decimal = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.abs(exponent) - 1), digits)
    tiny = F.concat(mantissa, F.lit("e-"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    body = (
        F.when(c == 0, "0")
        .when(exponent >= 0, mantissa)
        .when(exponent >= -4, decimal)
        .otherwise(tiny)
    )
    return F.concat(F.when(c < 0, "-").otherwise(""), body)


def humanize(c: Column) -> Column:
    """A number as prose: separators from 1000 up, two decimals from 1 up, else four digits."""
    number = finite(c)
    size = F.abs(number)
    return (
        F.when(number.isNull(), "n/a")
        .when(size >= 1000, F.format_number(number, 0))
        .when(size >= 1, F.regexp_replace(F.format_number(number, 2), r"\.?0+$", ""))
        .otherwise(_four_significant(number))
    )


def percent(c: Column, decimals: int = 1, signed: bool = False) -> Column:
    """A share as a percentage with fixed decimals."""
    return F.concat(fixed_point(c * 100, decimals, signed), F.lit("%"))


def mask_value(value: Column, pii_type: str | Column) -> Column:
    """Hide a personal value but keep enough of it to recognise a record."""
    kind = F.lit(pii_type) if isinstance(pii_type, str) else pii_type
    digits = F.regexp_replace(value, r"\D", "")
    masked_mail = F.concat(
        F.substring(value, 1, 1),
        F.lit("***@"),
        F.substring(value, F.locate("@", value) + 1, F.length(value)),
    )
    return (
        F.when(value.isNull(), "")
        .when((kind == "email") & (F.locate("@", value) == 1), F.concat(F.lit("***"), value))
        .when((kind == "email") & value.contains("@"), masked_mail)
        .when((kind == "phone") & (F.length(digits) >= 4), F.concat(F.lit("***"), F.right(digits, F.lit(4))))
        .when((kind == "phone") | (F.length(value) <= 2), "***")
        .otherwise(F.concat(F.substring(value, 1, 1), F.lit("***"), F.right(value, F.lit(1))))
    )
