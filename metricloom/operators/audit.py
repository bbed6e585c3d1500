"""Audit of a run: validation events, verdict, explanations, lineage and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.fixed_values import MIN_KPI_RATIO, MIN_QUALITY


def kpi_events(kpis: DataFrame) -> DataFrame:
    valid = (F.col("status") == "computed") & F.col("formula").isNotNull()
    return kpis.select(
        "run_id", F.lit("kpi_validation").alias("event_type"), F.col("kpi").alias("entity"),
        F.when(valid, "info").otherwise("error").alias("severity"),
        F.concat(F.lit("KPI "), F.col("name"), F.lit(": "), F.col("status")).alias("message"),
        F.when(valid, "VALID").otherwise("INVALID").alias("status"))


def finding_events(findings: DataFrame) -> DataFrame:
    return findings.select(
        "run_id", F.lit("insight_validation").alias("event_type"), F.col("title").alias("entity"),
        F.when(F.col("grounded"), "info").otherwise("warning").alias("severity"),
        F.concat(F.lit("Insight '"), F.col("title"), F.lit("' grounded="), F.col("grounded").cast("string")).alias("message"),
        F.when(F.col("grounded"), "VALID").otherwise("REJECTED").alias("status"))


def verdict(kpis: DataFrame, quality: DataFrame) -> DataFrame:
    """One row per run: enough KPIs, good enough data, anything to show. ``quality`` has ``(run_id, overall_score)``."""
    per_run = kpis.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("kpis"), F.count_if(F.col("status") == "computed").alias("computed"),
        F.count("value").alias("bound"))
    score = F.coalesce("overall_score", F.lit(0.0))
    ratio = F.col("computed") / F.col("kpis")
    few = (F.col("computed") == 0) | (ratio < MIN_KPI_RATIO)
    poor = (score != 0) & (score < MIN_QUALITY)
    done = F.format_string("%d of %d KPIs computed", F.col("computed"), F.col("kpis"))
    reason = (
        F.when(few, F.concat(F.lit("Only "), done, F.format_string(" (%.0f%%, below the %.0f%% bar).", ratio * 100, F.lit(MIN_KPI_RATIO * 100))))
        .when(poor, F.format_string("Data quality scored %.1f, below the %.1f threshold for publishing.", score, F.lit(MIN_QUALITY)))
        .when(F.col("bound") == 0, "No KPI is bound to a value.")
        .otherwise(F.concat(done, F.format_string(", quality %.1f, %d bound to a value.", score, F.col("bound")))))
    return per_run.join(quality, "run_id", "left").select(
        "run_id", F.when(few, "retry_semantic").when(poor, "retry_quality").when(F.col("bound") == 0, "INVALID")
        .otherwise("VALID").alias("status"), reason.alias("reason"), F.round(ratio, 4).alias("kpi_success_ratio"))


def explanations(kpis: DataFrame, transformations: DataFrame, caveats: DataFrame) -> DataFrame:
    """What each KPI says, how it came about and what limits it.

    ``transformations`` is a cleanup log with ``run_id``; ``caveats`` is ``(run_id, place, note)``.
    """
    where = F.concat_ws(".", "table_name", "column_name")
    step = F.format_string("%s on %s (%d rows)", F.col("operation"), where, F.col("rows_affected"))
    applied = transformations.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("step", step.alias("text")))).alias("_steps"))
    notes = caveats.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("place", "note"))).alias("_notes"))
    roles = F.array_join(F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), ", ")
    shown = F.coalesce(F.format_number("value", 2), F.lit("no value"))
    return kpis.join(applied, "run_id", "left").join(notes, "run_id", "left").select(
        "run_id", "kpi",
        F.concat(F.col("name"), F.lit(" evaluated to "), shown, F.coalesce(F.concat(F.lit(" "), F.col("unit")), F.lit("")), F.lit(".")).alias("what_happened"),
        F.concat(F.lit("Aggregated over the cleaned layer as "), F.col("formula"), F.lit(".")).alias("how_calculated"),
        F.concat_ws(", ", "tables").alias("data_used"), F.col("business_meaning").alias("kpi_relevance"),
        F.concat(
            F.lit("Roles bound as: "), F.when(roles == "", "none bound").otherwise(roles), F.lit(". "),
            F.coalesce(F.concat(F.lit("Revenue basis: "), F.col("revenue_basis"), F.lit(". ")), F.lit("")),
            F.when(F.size("filters") > 0, F.concat(F.lit("Row filter applied: "), F.concat_ws("; ", "filters"), F.lit(". "))).otherwise(""),
            F.lit("A zero divisor gives null.")).alias("assumptions"),
        F.coalesce(F.array_join(F.col("_notes.note"), "; "), F.lit("No type-inference caveats were raised.")).alias("quality_limitations"),
        F.coalesce(F.array_join(F.col("_steps.text"), ", "), F.lit("none")).alias("transformations"))


def lineage_nodes(kpis: DataFrame) -> DataFrame:
    """Layers each KPI passed through."""
    node = lambda i, kind, label: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("type"), label.alias("label"))
    layers = F.array(
        node("run", "pipeline_run", F.concat(F.lit("Run "), F.substring("run_id", 1, 8))),
        node("raw", "layer", F.lit("RAW")), node("transform", "transformation", F.lit("TRANSFORM")),
        node("clean", "layer", F.lit("CLEAN")), node("semantic", "semantic", F.lit("SEMANTIC MODEL")),
        node("kpi", "kpi", F.col("name")))
    return kpis.select("run_id", "kpi", F.inline(layers))


def lineage_edges(kpis: DataFrame) -> DataFrame:
    steps = [("run", "raw", "input"), ("raw", "transform", "profiled"), ("transform", "clean", "applied"),
             ("clean", "semantic", "modeled"), ("semantic", "kpi", "computed")]  # fixed values
    edge = lambda a, b, label: F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.lit(label).alias("label"))
    return kpis.select("run_id", "kpi", F.inline(F.array(*[edge(*s) for s in steps])))


def formula_validity(kpis: DataFrame) -> DataFrame:
    valid = (F.col("status") == "computed") & F.col("formula").isNotNull()
    return _metric(kpis, "semantic", "kpi_formula_validity", F.coalesce(F.avg(valid.cast("double")), F.lit(0.0)))


def groundedness(findings: DataFrame) -> DataFrame:
    """Share of findings borne out by a computed figure; saying nothing scores 1."""
    return _metric(findings, "analyst", "insight_groundedness", F.coalesce(F.avg(F.col("grounded").cast("double")), F.lit(1.0)))


def hallucination_rate(findings: DataFrame) -> DataFrame:
    return _metric(findings, "analyst", "hallucination_rate", 1 - F.coalesce(F.avg(F.col("grounded").cast("double")), F.lit(1.0)))


def type_resolution(decisions: DataFrame) -> DataFrame:
    resolved = (F.col("action") != "keep") | (F.lower("target_type") != "string")
    return _metric(decisions, "profiler", "type_inference_resolution", F.coalesce(F.avg(resolved.cast("double")), F.lit(0.0)))


def binding_rate(kpis: DataFrame) -> DataFrame:
    return _metric(kpis, "dashboard", "kpis_bound_to_data", F.coalesce(F.avg(F.col("value").isNotNull().cast("double")), F.lit(0.0)))


def baseline_lift(kpis: DataFrame, columns: DataFrame) -> DataFrame:
    """Catalogue KPIs per KPI of a naive report: one sum or average for every numeric column."""
    naive = F.col("logical_type").isin("currency", "quantity", "numeric") & ~F.col("is_candidate_pk")
    counts = kpis.agg(F.count_if(F.col("source") == "catalog").alias("catalog")).unionByName(
        columns.agg(F.count_if(naive).alias("naive")), allowMissingColumns=True)
    return _metric(counts, "semantic", "vs_naive_baseline", F.max("catalog") / F.greatest(F.max("naive"), F.lit(1)))


def _metric(df: DataFrame, area: str, name: str, value) -> DataFrame:
    return df.agg(F.lit(area).alias("area"), F.lit(name).alias("metric_name"), F.round(value, 4).alias("score"))
