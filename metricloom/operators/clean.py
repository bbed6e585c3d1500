"""Conservative cleanups with a log: planned from issues, applied in order, counted."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.fixed_values import WHITESPACE
from metricloom.functions.text import is_padded, strip
from metricloom.operators.infer import parse_datetime
from metricloom.operators.profile import repeated_rows
from metricloom.session import settle, together

LOG = """table_name string, step int, operation string, column_name string, rows_affected bigint, reason string,
before_example string, after_example string"""

PLANNED = {"whitespace": "trim_whitespace", "empty_string": "empty_to_null", "duplicates": "drop_duplicates"}
ROW_STEPS = ("drop_duplicates", "drop_all_null_rows")


@dataclass(frozen=True)
class Step:
    operation: str
    table_name: str
    column_name: str | None = None
    reason: str = ""
    format: str | None = None


def plan_steps(issues: DataFrame) -> DataFrame:
    """The cleanup each issue calls for, once per (operation, table, column); nothing else is planned."""
    operation = F.create_map(*[F.lit(x) for pair in PLANNED.items() for x in pair])[F.col("issue_type")]
    place = F.when(F.col("issue_type") == "duplicates", 0).when(F.col("issue_type") == "whitespace", 1).otherwise(2)
    return (
        issues.where(F.col("issue_type").isin(*PLANNED))
        .select("table_name", operation.alias("operation"), "column_name",
                F.col("recommended_action").alias("reason"), place.alias("place"))
        .dropDuplicates(["operation", "table_name", "column_name"])
    )


def collect_plan(issues: DataFrame) -> list[Step]:
    """The plan as steps: a few per column. Trimming comes before empty strings are nulled."""
    rows = plan_steps(issues).orderBy("table_name", F.col("column_name").asc_nulls_first(), "place").collect()
    return [Step(r["operation"], r["table_name"], r["column_name"], r["reason"]) for r in rows]


class _Table:
    """One table under a plan: rows as read, values as changed so far, and the counts each step asks for.

    Counts are aggregates over the rows themselves, so a task that runs again counts nothing
    twice. Once copies are to go, a row counts once for all its copies: the rows are counted as
    they are, and the surplus of those that repeat is taken off, which needs no second shuffle
    of the table.
    """

    def __init__(self, df: DataFrame, keep: Callable[[DataFrame], DataFrame]):
        self.keep, self.counts = keep, {}
        self._start(df)

    def _start(self, df: DataFrame) -> None:
        self.rows, self.copies, self.alive = df, None, None
        self.values: dict[str, Column] = {}
        self.flags: dict[str, Column] = {}
        self.examples: dict[str, Column] = {}
        self.surplus: list[str] = []

    def value(self, column: str) -> Column:
        return self.values.get(column, F.col(f"`{column}`"))

    def result(self) -> DataFrame:
        df = self.rows if self.copies is None else self.rows.dropDuplicates()
        if self.alive is not None:
            df = df.where(self.alive)
        return df.withColumns(self.values) if self.values else df

    def measure(self) -> None:
        """All counts asked for so far, in one aggregation."""
        if not (self.flags or self.examples or self.surplus):
            return
        sums = lambda weight: [F.coalesce(F.sum(F.when(flag, weight).otherwise(0)), F.lit(0)).cast("bigint").alias(n) for n, flag in self.flags.items()]
        parts = [self.rows.agg(F.lit(0).cast("bigint").alias("_"), *sums(F.lit(1)), *[F.min(e).alias(n) for n, e in self.examples.items()])]
        if self.copies is not None:
            extra = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint")
            parts.append(self.copies.agg(*sums(1 - F.col("_n")), *[extra.alias(n) for n in self.surplus]))
        both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        whole = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*self.flags, *self.surplus)]
        self.counts.update(both.agg(*whole, *[F.min(n).alias(n) for n in self.examples]).first().asDict())

    def apply(self, i: int, step: Step) -> None:
        if step.operation == "drop_duplicates":
            if self.values or self.alive is not None or self.copies is not None:
                self.measure()
                self._start(self.keep(self.result()))
            self.copies = repeated_rows(self.rows)
            self.surplus.append(f"count{i}")
            return
        here = F.lit(True) if self.alive is None else self.alive
        if step.operation == "drop_all_null_rows":
            filled = reduce(Column.__or__, [self.value(c).isNotNull() for c in self.rows.columns], F.lit(False))
            self.flags[f"count{i}"] = here & ~filled
            self.alive = here & filled
            return
        c = self.value(step.column_name)
        if step.operation == "trim_whitespace":
            flag, changed = is_padded(c), strip(c)
            self.examples[f"example{i}"] = F.when(flag & here, c)
        elif step.operation == "empty_to_null":
            flag, changed = c == "", F.nullif(c, F.lit(""))
        elif step.operation == "normalize_case":
            flag, changed = F.lit(True), F.lower(c)
        elif step.operation == "cast_numeric":
            flag, changed = F.lit(True), c.try_cast("double")
        elif step.operation == "cast_datetime":
            parsed = parse_datetime(c, step.format) if step.format else F.try_to_timestamp(c).cast("timestamp_ntz")
            flag, changed = F.lit(True), parsed
        else:
            raise ValueError(f"Unknown cleanup {step.operation!r}")
        self.flags[f"count{i}"] = flag & here
        self.values[step.column_name] = changed


def _apply(df: DataFrame, steps: Sequence[tuple[int, Step]], keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict]:
    table = _Table(df, keep)
    for i, step in steps:
        if step.operation in ROW_STEPS or step.column_name in df.columns:
            table.apply(i, step)
    table.measure()
    return table.result(), table.counts


def _log(spark: SparkSession, steps: Sequence[tuple[int, Step]], counts: dict) -> DataFrame:
    rows = []
    for i, s in steps:
        if f"count{i}" not in counts:
            continue
        before = "" if s.operation == "empty_to_null" else counts.get(f"example{i}")
        after = before.strip(WHITESPACE) if before and s.operation == "trim_whitespace" else None
        rows.append((s.table_name, i, s.operation, s.column_name, counts[f"count{i}"], s.reason, before, after))
    return spark.createDataFrame(rows, LOG)


def _by_table(plan: Sequence[Step]) -> dict[str, list[tuple[int, Step]]]:
    found: dict[str, list[tuple[int, Step]]] = {}
    for i, step in enumerate(plan):
        found.setdefault(step.table_name, []).append((i, step))
    return found


def _run(tables: Mapping[str, DataFrame], plan: Sequence[Step], keep: Callable, finish: Callable[[str, DataFrame], DataFrame]):
    numbered = _by_table(plan)

    def one(name: str) -> tuple[DataFrame, dict]:
        out, counts = _apply(tables[name], numbered.get(name, []), keep)
        return finish(name, out), counts

    done = dict(zip(tables, together(*[lambda n=n: one(n) for n in tables]), strict=True))
    counts = {k: v for _, found in done.values() for k, v in found.items()}
    steps = [pair for name, own in numbered.items() if name in tables for pair in own]
    return {name: out for name, (out, _) in done.items()}, _log(next(iter(tables.values())).sparkSession, steps, counts)


def execute_plan(tables: Mapping[str, DataFrame], plan: Sequence[Step]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Cleaned tables (lazy) and the log. Counts take one aggregation per table, one more per later removal of copies."""
    return _run(tables, plan, lambda df: df, lambda name, df: df)


def clean_to(tables: Mapping[str, DataFrame], plan: Sequence[Step], folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write the cleaned layer, and log every step. Rows from which copies go late in a plan are written ahead of that."""

    def write(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return _run(tables, plan, settle, write)
