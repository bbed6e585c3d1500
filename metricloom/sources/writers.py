"""Writing the cleaned layer, the KPI catalogue and the report; table registration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.text import sanitize_name

CATALOGUE_COLUMNS = ("name", "value", "unit", "change_pct", "status", "formula", "sql", "business_meaning")


def write_layer(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def register_layer(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Views over a written layer, under sanitised names."""
    views = []
    for name in names:
        spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(sanitize_name(name))
        views.append(sanitize_name(name))
    return views


def register_frames(tables: Mapping[str, DataFrame]) -> list[str]:
    for name, df in tables.items():
        df.createOrReplaceTempView(sanitize_name(name))
    return [sanitize_name(n) for n in tables]


def write_catalogue_csv(kpi_values: DataFrame, path: str) -> None:
    """The KPI catalogue as CSV with a header."""
    kpi_values.select(*CATALOGUE_COLUMNS).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_report(sections: Mapping[str, DataFrame], folder: str) -> None:
    """Every artefact as JSON lines, one folder per section."""
    for name, df in sections.items():
        df.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(f"{folder}/{name}")
