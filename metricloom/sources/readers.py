"""Reading tables: by suffix, delimiter detection, types from evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Delimiters offered, in order of preference.
DELIMITERS = (",", ";", "\t", "|")
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class CsvShape:
    """What a look at all lines of CSV files tells: the delimiter, and whether a record may hold line breaks."""

    delimiter: str
    multi_line: bool


def _open_blocks(lines: DataFrame) -> DataFrame:
    """(file, block) of the file parts that begin inside quotes: an odd number of quotes stands before them."""
    odd = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per file part
    return odd.withColumn("open", F.sum("odd").over(before) % 2 == 1).where("open").select("file", "block")


def _outside_quotes(lines: DataFrame) -> DataFrame:
    """Delimiters outside quotes, where quotes go on over line ends: each task follows its lines, from how their file part begins."""
    opened = {(r["file"], r["block"]) for r in _open_blocks(lines).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, inside, found = None, False, [0] * len(DELIMITERS)
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != place:
                    place, inside = (file, block), (file, block) in opened
                parts = line.split('"')
                for bare in parts[1 if inside else 0::2]:
                    for i, d in enumerate(DELIMITERS):
                        found[i] += bare.count(d)
                inside ^= len(parts) % 2 == 0
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in found], names=[str(i) for i in range(len(found))])

    return lines.select("file", "block", "value").mapInArrow(count, ", ".join(f"`{i}` long" for i in range(len(DELIMITERS))))


def csv_shape(spark: SparkSession, path: str, encoding: str = "UTF-8") -> CsvShape:
    """Shape of all lines of a path: the delimiter that occurs most often outside quotes, a comma when none does.

    If every line has an even number of quotes, each line is a record, so that large files can be
    read in parts; one line with an odd number means that records may go on over line ends.
    """
    lines = spark.read.option("encoding", encoding).text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("quotes"))
    bare = F.regexp_replace("value", '"[^"]*"', "")
    found = lines.select("quotes", bare.alias("bare")).agg(F.count_if(F.col("quotes") % 2 == 1).alias("odd"), *[
        F.sum(F.length("bare") - F.length(F.replace("bare", F.lit(d)))).alias(str(i)) for i, d in enumerate(DELIMITERS)
    ]).first()
    counts = found
    if found["odd"]:
        counts = _outside_quotes(lines).agg(*[F.sum(F.col(f"`{i}`")).alias(str(i)) for i in range(len(DELIMITERS))]).first()
    best = max(range(len(DELIMITERS)), key=lambda i: (counts[str(i)] or 0, -i))
    return CsvShape(DELIMITERS[best] if counts[str(best)] else ",", bool(found["odd"]))


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The candidate that occurs most often outside quotes, over the whole file; a comma when none does."""
    return csv_shape(spark, path, encoding).delimiter


def read_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", multi_line: bool | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV as text columns; types are decided from evidence afterwards, never on reading.

    Columns come from the header. Records may hold line breaks in quotes, which makes each file
    one task; unless ``multi_line`` says whether they do, the quotes of all lines are looked at. A
    record with more or fewer fields than the header keeps those that fit, and with
    ``keep_corrupt`` its text.
    """
    if delimiter is None or multi_line is None:
        shape = csv_shape(spark, path, encoding)
        delimiter = delimiter or shape.delimiter
        multi_line = shape.multi_line if multi_line is None else multi_line
    options = {"sep": delimiter, "header": True, "encoding": encoding, "multiLine": multi_line, "escape": '"'}
    names = spark.read.csv(path, inferSchema=False, **options).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    df = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)
    return df if keep_corrupt else df.drop(CORRUPT)


def malformed(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """``(row_count, malformed_count)``: records of a CSV whose fields do not fit the header."""
    df = read_csv(spark, path, keep_corrupt=True, **csv_options)
    # the reader refuses plans that read nothing but the corrupt record
    any_field = F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns if c != CORRUPT])
    return df.select(any_field.alias("fields"), F.col(CORRUPT).isNotNull().alias("bad")).agg(
        F.count_if(F.length("fields") >= 0).alias("row_count"), F.count_if(F.col("bad") & (F.length("fields") >= 0)).alias("malformed_count"))


def read_typed(spark: SparkSession, path: str, name: str, **options):
    """A table read and its types inferred: ``(frame, decisions)``."""
    from metricloom.operators.infer import infer_types

    return infer_types(read_table(spark, path, **options), name)


def read_table(spark: SparkSession, path: str, n_rows: int | None = None, **csv_options) -> DataFrame:
    """A table by file suffix (.csv, .parquet); ``n_rows`` is the sampling operator."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        df = read_csv(spark, path, **csv_options)
    elif suffix == ".parquet" or suffix == "":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"Unsupported file type: {suffix}")
    return df if n_rows is None else df.limit(n_rows)


def sample(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def metadata(df: DataFrame, name: str, source_type: str = "parquet") -> DataFrame:
    """``(name, source_type, row_count, column_count, fields)`` of a table."""
    fields = F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.lit(f.nullable).alias("nullable")) for f in df.schema
    ])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("name"), F.lit(source_type).alias("source_type"), "row_count",
        F.lit(len(df.columns)).alias("column_count"), fields.alias("fields"),
    )
