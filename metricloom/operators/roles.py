"""Business roles: scoring, assignment, returns convention, dimensions, domains."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom import fixed_values as fixed

# Role scores.
BASE, TYPE_FITS, TYPE_ODD, EXACT_NAME, LOWEST = 0.55, 0.25, -0.2, 0.2, 0.5


def _rules() -> Column:
    """The fixed rules as an array of rows: one set of expressions scores all of them."""
    rows = [dict(zip(("role", "kind", "patterns", "types", "ruled_out"), (r, k, list(p), list(t), list(o)))) for r, k, p, t, o in fixed.ROLES]
    schema = "array<struct<role:string,kind:string,patterns:array<string>,types:array<string>,ruled_out:array<string>>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def score_roles(columns: DataFrame) -> DataFrame:
    """Candidate roles of every profiled column, one row per role that scores above the floor.

    A role is a candidate where one of its patterns fits the name and none that rules it out.
    """
    keep = ["table_name", "column_name", "position", "logical_type", "distinct_count", "null_pct"]
    facts = columns.select(*keep, "row_count", "mean", "is_candidate_pk", F.lower("column_name").alias("_name"), F.inline(_rules()))
    fit = facts.withColumn("_pattern", F.expr("get(filter(patterns, p -> _name rlike p), 0)")).where(
        "_pattern is not null and not exists(ruled_out, p -> _name rlike p)")
    many = f"(logical_type <> 'datetime' and distinct_count > {fixed.MAX_AXIS_VALUES})"
    few = f"(logical_type <> 'datetime' and distinct_count <= {fixed.MAX_AXIS_VALUES})"
    entity, measure, axis = (f"kind = '{k}'" if k else "kind not in ('identifier', 'measure')" for k in ("identifier", "measure", ""))
    steps = [  # (condition, points, reason) in the order reasons are given
        ("true", BASE, "concat('name matches /', _pattern, '/')"),
        ("array_contains(types, logical_type)", TYPE_FITS, "concat('logical type ', logical_type)"),
        ("not array_contains(types, logical_type)", TYPE_ODD, "concat('logical type ', logical_type, ' is unusual for this role')"),
        (f"{entity} and distinct_count > 0 and distinct_count < row_count", 0.15, "concat(distinct_count, ' distinct values below the row count')"),
        (f"{entity} and null_pct > 50", -0.25, "format_string('%.1f%% null', null_pct)"),
        (f"{measure} and mean is not null", 0.1, "'numeric statistics available'"),
        (f"{measure} and is_candidate_pk", -0.5, "'unique per row, so it behaves like a key'"),
        (f"{axis} and logical_type = 'datetime'", 0.1, "cast(null as string)"),
        (f"{axis} and {many}", -0.3, "concat(distinct_count, ' distinct values is too many to chart')"),
        (f"{axis} and {few}", 0.1, "concat(distinct_count, ' distinct values')"),
        ("_name in (role, replace(role, '_', ''), replace(role, '_id', ''))", EXACT_NAME, "'name matches the role exactly'"),
    ]
    total = " + ".join(f"case when {test} then {points}D else 0D end" for test, points, _ in steps)
    reason = ", ".join(f"case when {test} then {text} end" for test, _, text in steps)
    return (
        fit.withColumn("score", F.expr(f"greatest(0D, least(1D, {total}))")).withColumn("reason", F.expr(f"concat_ws('; ', {reason})"))
        .where(F.col("score") > LOWEST)
        .select("role", "table_name", "column_name", F.round("score", 4).alias("confidence"), "reason",
                "logical_type", "distinct_count", "null_pct", "position")
    )


def assign_roles(scores: DataFrame, dataset: str = "dataset") -> DataFrame:
    """At most one column per role and one role per column, per dataset.

    Roles in fixed order take their best free column: a fold over a dataset's candidates, which
    are a row per column and fitting role. Datasets run in parallel.
    """
    if dataset not in scores.columns:
        scores = scores.withColumn(dataset, F.lit("main"))
    place = F.array_position(F.array(*map(F.lit, fixed.ROLE_ORDER)), F.col("role"))
    turn = F.struct(place.alias("place"), (-F.col("confidence")).alias("worth"), "table_name", "position", F.struct(*scores.columns).alias("row"))
    candidates = scores.where(place > 0).groupBy(dataset).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    none = F.array().cast(f"array<{scores.select(turn.alias('t')).schema['t'].dataType.simpleString()}>")
    same_column = lambda t, k: (t.row.table_name == k.row.table_name) & (t.row.column_name == k.row.column_name)
    free = lambda kept, t: ~F.exists(kept, lambda k: (k.place == t.place) | same_column(t, k))
    chosen = F.aggregate("turns", none, lambda kept, t: F.when(free(kept, t), F.concat(kept, F.array(t))).otherwise(kept))
    return candidates.select(F.inline(F.transform(chosen, lambda t: t.row)))


def with_overrides(bindings: DataFrame, columns: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """Bindings with the caller's choices (role to ``table.column``) in place of those found."""
    if not overrides:
        return bindings
    rows = [(role, *full.split(".", 1)) for role, full in overrides.items()]
    chosen = bindings.sparkSession.createDataFrame(rows, "role string, table_name string, column_name string")
    facts = columns.select("table_name", "column_name", "logical_type", "distinct_count", "null_pct", "position")
    chosen = chosen.join(facts, ["table_name", "column_name"], "left").withColumns(
        {"confidence": F.lit(1.0), "reason": F.lit("set by the caller")})
    return bindings.where(~F.col("role").isin(*overrides)).unionByName(chosen, allowMissingColumns=True)


def returns_convention(df: DataFrame, quantity: str | None, order_id: str | None) -> DataFrame:
    """How cancellations show: negative quantities, and a leading letter on a minority of ids.

    Rows are first counted per leading letter, so the second step sees a few dozen rows.
    """
    no = F.lit(None)
    units = F.col(quantity).cast("double") if quantity else no.cast("double")
    key = F.col(order_id).cast("string") if order_id else no.cast("string")
    letter = F.when(key.rlike("^[A-Za-z]"), F.substring(key, 1, 1))
    per_letter = df.groupBy(letter.alias("letter")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(key).alias("ids"), F.count_if(units < 0).alias("negative")
    )
    best = F.min_by("letter", F.when(F.col("letter").isNotNull(), F.struct((-F.col("ids")).alias("n"), "letter")))
    totals = per_letter.agg(
        F.sum("rows").alias("rows"), F.sum("ids").alias("ids"), F.sum("negative").alias("negative"),
        F.coalesce(F.sum(F.when(F.col("letter").isNotNull(), F.col("ids"))), F.lit(0)).alias("prefixed"),
        best.alias("letter"), F.max(F.when(F.col("letter").isNotNull(), F.col("ids"))).alias("letter_rows"),
    )
    marked = (F.col("prefixed") > 0) & (F.col("prefixed") < F.col("ids") * 0.5)
    negative = F.coalesce("negative", F.lit(0))
    return totals.select(
        (negative > 0).alias("has_negative_quantity"), negative.alias("negative_quantity_rows"),
        F.when(negative > 0, F.round(negative / F.greatest("rows", F.lit(1)), 6)).alias("negative_quantity_share"),
        F.when(marked, F.col("letter")).alias("cancel_prefix"),
        F.when(marked, F.col("letter_rows")).otherwise(0).alias("cancel_prefix_rows"),
        F.when(marked, F.round(F.col("letter_rows") / F.col("ids"), 6)).alias("prefix_share"),
    )


def _charted(columns: DataFrame, max_values: int) -> DataFrame:
    """Times and labels with their worth as an axis, and why a column is no axis (null: it is one)."""
    time, label = F.col("logical_type") == "datetime", F.col("logical_type").isin("geo", "categorical")
    worth = F.when(time, 0.9).otherwise(0.8 - F.least(F.lit(0.3), F.col("distinct_count") / (max_values * 4)))
    reason = (
        F.when(F.col("is_candidate_pk"), "each row has a value of its own")
        .when(label & (F.col("distinct_count") > max_values), F.format_string(f"%d distinct values, more than {max_values}", "distinct_count"))
    )
    return columns.where(time | label).withColumns({"confidence": F.round(worth, 4), "reason": reason})


def chart_dimensions(columns: DataFrame, max_values: int = fixed.MAX_AXIS_VALUES) -> DataFrame:
    """Columns worth an axis: times first, then labels of at most ``max_values`` values, the fewer the better."""
    return _charted(columns, max_values).where("reason is null").select(
        "table_name", "column_name", "logical_type", "distinct_count", "confidence", "position")


def left_out_dimensions(columns: DataFrame, max_values: int = fixed.MAX_AXIS_VALUES) -> DataFrame:
    """Times and labels that ``chart_dimensions`` leaves out, and why."""
    return _charted(columns, max_values).where("reason is not null").select(
        "table_name", "column_name", "logical_type", "distinct_count", "reason", "position")


def unbound_notes(bindings: DataFrame) -> DataFrame:
    """A note for every key role that no column took."""
    spark = bindings.sparkSession
    expected = spark.createDataFrame([(r,) for r in fixed.EXPECTED_ROLES], "role string")
    return expected.join(bindings.select("role"), "role", "left_anti").select(
        "role", F.concat(F.lit("No column bound to role '"), F.col("role"),
                         F.lit("'; KPIs that need it were not generated.")).alias("note"))


def model_dimensions(columns: DataFrame, max_values: int = fixed.MAX_AXIS_VALUES) -> DataFrame:
    chart = chart_dimensions(columns, max_values).select("table_name", "column_name")
    time = F.col("logical_type") == "datetime"
    return columns.join(chart, ["table_name", "column_name"], "left_semi").orderBy("table_name", "position").select(
        "table_name", "column_name", F.col("logical_type").alias("dim_type"),
        F.when(time, F.col("granularity")).alias("grain"), F.col("semantic_hint").alias("description"))


def model_measures(columns: DataFrame) -> DataFrame:
    money = F.col("logical_type") == "currency"
    summed = money | (F.col("logical_type") == "quantity")
    measures = columns.where(F.col("logical_type").isin("currency", "quantity", "numeric") & ~F.col("is_candidate_pk"))
    return measures.orderBy("table_name", "position").select(
        "table_name", "column_name", F.when(summed, "SUM").otherwise("AVG").alias("aggregation"),
        F.when(money, "currency").alias("unit"), F.col("semantic_hint").alias("description"))


def infer_domain(datasets: DataFrame, objective: Column, columns: Column | None = None) -> DataFrame:
    """Business domain of each row's objective and column names, with the terms that matched.

    Ties go to the domain listed first; ``general`` when nothing matches. Adds ``domain``,
    ``score``, ``matched_terms`` and ``confident``.
    """
    parts = [F.coalesce(objective, F.lit(""))] + ([] if columns is None else [F.array_join(columns, " ")])
    blob = F.lower(F.concat_ws(" ", *parts))
    scored = []
    for i, (domain, terms) in enumerate(fixed.DOMAIN_TERMS.items()):
        hits = sum((F.when(F.col("_blob").contains(t), 1).otherwise(0) for t in terms), F.lit(0))
        matched = F.array_sort(F.array_distinct(F.array_compact(F.array(*[
            F.when(F.col("_blob").contains(t), F.lit(t)) for t in terms]))))
        scored.append(F.struct(hits.alias("score"), F.lit(-i).alias("place"), F.lit(domain).alias("domain"),
                               matched.alias("terms")))
    best = F.array_max(F.array(*scored))
    found = datasets.withColumn("_blob", blob).withColumn("_best", best)
    return found.select(
        *datasets.columns, F.col("_best.domain").alias("domain"), F.col("_best.score").alias("score"),
        F.col("_best.terms").alias("matched_terms"),
        ((F.col("_best.domain") != "general") & (F.col("_best.score") > 0)).alias("confident"),
    )


@dataclass(frozen=True)
class Binding:
    """Roles bound to ``table.column`` names, the returns convention and chart dimensions."""

    roles: Mapping[str, str]
    cancel_prefix: str | None = None
    has_negative_quantity: bool = False
    dimensions: tuple[tuple[str, str], ...] = field(default_factory=tuple)  # (table.column, logical type)

    def has(self, *roles: str) -> bool:
        return all(r in self.roles for r in roles)

    @property
    def returns(self) -> bool:
        return self.has_negative_quantity or self.cancel_prefix is not None

    def with_overrides(self, overrides: Mapping[str, str]) -> Binding:
        return Binding({**self.roles, **overrides}, self.cancel_prefix, self.has_negative_quantity, self.dimensions)


def bind(
    tables: Mapping[str, DataFrame], columns: DataFrame, overrides: Mapping[str, str] | None = None, max_values: int = fixed.MAX_AXIS_VALUES,
    assigned: DataFrame | None = None,
) -> Binding:
    """Bind roles for one dataset; reads back a row per role and per dimension. ``assigned`` are its bindings, if they are there."""
    assigned = assign_roles(score_roles(columns)) if assigned is None else assigned
    rows = assigned.select("role", "table_name", "column_name").collect()
    roles = {**{r["role"]: f"{r['table_name']}.{r['column_name']}" for r in rows}, **(overrides or {})}
    dims = chart_dimensions(columns, max_values).orderBy(F.col("confidence").desc(), "table_name", "position").collect()
    prefix, negative = None, False
    split = {r: ref.split(".", 1) for r, ref in roles.items() if r in ("quantity", "order_id")}
    for table in dict.fromkeys(t for t, _ in split.values()):
        own = {r: c for r, (t, c) in split.items() if t == table}
        found = returns_convention(tables[table], own.get("quantity"), own.get("order_id")).first()
        prefix, negative = prefix or found["cancel_prefix"], negative or bool(found["has_negative_quantity"])
    return Binding(roles, prefix, negative,
                   tuple((f"{d['table_name']}.{d['column_name']}", d["logical_type"]) for d in dims))
