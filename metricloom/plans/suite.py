"""A whole run: raw tables in, audited business metrics out, every artefact a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.fixed_values import MAX_AXIS_VALUES
from metricloom.operators import audit, clean, insights, joins, pii, quality, roles, series, stats
from metricloom.operators.catalog import KpiSpec, catalogue_frame, fallback, instantiate, quoted
from metricloom.operators.counts import TextCounts
from metricloom.operators.infer import decisions_frame, infer_with_counts
from metricloom.operators.measures import (
    SpecError, distinct_counts_by, distinct_leaves, evaluate, first_dimension, grouped, spec_problems, to_long,
)
from metricloom.operators.profile import duplicate_rows, profile_columns, profile_tables
from metricloom.session import checkpoint_dir, kept, settle, together

SEGMENTS = 15  # segments of a KPI that are listed if the caller names no number; shares are of all of them


@dataclass
class KpiResults:
    values: DataFrame
    series: DataFrame
    breakdown: DataFrame


def _bases(specs: Sequence[KpiSpec]) -> dict[tuple[str, ...], list[KpiSpec]]:
    found: dict[tuple[str, ...], list[KpiSpec]] = {}
    for s in specs:
        found.setdefault(s.tables, []).append(s)
    return found


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def compute_kpis(
    tables: Mapping[str, DataFrame], specs: Sequence[KpiSpec], binding: roles.Binding, run_id: str,
    relationships: Sequence[joins.Relationship] = (), segments: int = SEGMENTS,
) -> KpiResults:
    """Value, series and breakdown of every KPI: one aggregation each per set of joined tables.

    A breakdown is by the first label dimension, in the order of their worth, that has any value
    on the joined tables.
    """
    first = next(iter(tables.values()))
    spark = first.sparkSession
    values, points, parts, failed = [], [], [], {}
    for names, group in _bases(specs).items():
        try:
            base = joins.join_tables(tables, names, relationships)
        except SpecError:
            failed.update({s.slug: "invalid_formula" for s in group})
            continue
        refused = spec_problems(base, {s.slug: s.measure for s in group})
        failed.update(dict.fromkeys(refused, "invalid_formula"))
        measures = {s.slug: s.measure for s in group if s.slug not in refused}
        if not measures:
            continue
        date, seen, groupings = binding.roles.get("event_date"), None, {"value": {}}
        if date and date.split(".", 1)[0] in names:
            seen = series.time_range(tables[date.split(".", 1)[0]], F.col(f"`{date.split('.', 1)[1]}`"))
            groupings["series"] = {"period": series.period_of(F.col(quoted(date)), seen.grain)}
        labels = [d for d, kind in binding.dimensions if kind != "datetime" and d.split(".", 1)[0] in names]
        place = first_dimension(base, [F.col(quoted(d)) for d in labels])
        if place is not None:
            groupings["breakdown"] = {"dimension": F.col(quoted(labels[place])).cast("string")}
        wanted = distinct_leaves(measures)
        distinct = dict(zip(groupings, distinct_counts_by(base, list(groupings.values()), wanted))) if wanted else {}
        values.append(to_long(evaluate(base, measures, distinct=distinct.get("value")), [], list(measures)))
        if seen is not None:
            points.append(series.kpi_series(base, measures, F.col(quoted(date)), seen=seen, distinct=distinct.get("series")))
        if place is not None:
            broken = grouped(base, measures, F.col(quoted(labels[place])), limit=segments, totals=True, distinct=distinct.get("breakdown"))
            parts.append(broken.withColumn("dimension_name", F.lit(labels[place])))
    run = F.lit(run_id).alias("run_id")
    union = lambda frames, schema: reduce(DataFrame.unionByName, frames) if frames else _empty(first, schema)
    # Small tables (a row per KPI, point or segment) that many findings read: computed once.
    value, line, part = together(
        lambda: kept(union(values, "kpi string, value double")),
        lambda: settle(union(points, "period timestamp_ntz, kpi string, value double, partial boolean").select(run, "*")),
        lambda: kept(union(parts, "dimension string, kpi string, value double, rank int, segments bigint, total double, dimension_name string").select(run, "*")),
    )
    change = series.period_change(line, ["run_id", "kpi"]).drop("run_id")
    catalogue = catalogue_frame(spark, specs).withColumnRenamed("slug", "kpi")
    errors = spark.createDataFrame(list(failed.items()), "kpi string, error string")
    result = (
        catalogue.join(value, "kpi", "left").join(change, "kpi", "left").join(errors, "kpi", "left")
        .withColumn("status", F.coalesce("error", F.when(F.col("value").isNull(), "null_result").otherwise("computed")))
        .select(run, "*", F.lit(None).cast("string").alias("sql")).drop("error")
    )
    return KpiResults(result, line, part)


def run_suite(
    tables: Mapping[str, DataFrame], objective: str = "", domain: str | None = None, folder: str | None = None,
    overrides: Mapping[str, str] | None = None, run_id: str | None = None, segments: int = SEGMENTS,
    axis_values: int = MAX_AXIS_VALUES, approximate: bool = False,
) -> dict[str, DataFrame]:
    """Infer, profile, score, clean, bind, compute, analyse and audit. Returns every artefact by name.

    ``segments`` of a breakdown are listed; labels of more than ``axis_values`` values are no
    dimensions and listed, with the reason, under ``dimensions_left_out``. ``approximate`` takes
    distinct counts, quartiles and frequent values of the profiles from sketches.

    Joins are found on the raw tables, KPIs are computed on the cleaned layer, which is written
    as Parquet under ``folder`` (the session's checkpoint folder when none is given).
    """
    spark = next(iter(tables.values())).sparkSession
    run_id = run_id or uuid.uuid4().hex
    folder = f"{folder or checkpoint_dir(spark)}/{run_id}-{uuid.uuid4().hex[:12]}"  # no run overwrites another's

    # Types, profiles, quality
    typed, texts, decisions = {}, {}, []
    for name, df in tables.items():
        typed[name], found, texts[name] = infer_with_counts(df, name)
        if any(d.action != "keep" for d in found):
            typed[name] = settle(typed[name])  # parsed once, read many times
        decisions += found
    decided = decisions_frame(spark, decisions)
    (raw_columns, raw_tables), relations = together(
        lambda: _profile(typed, texts, approximate), lambda: kept(joins.discover_joins(typed)) if len(typed) > 1 else None)
    issues, *personal = together(
        lambda: kept(quality.quality_issues(raw_columns, raw_tables, decided, relations)),
        *[lambda n=n, df=df: pii.detect_pii(df, n, texts[n]) for n, df in typed.items()])
    scores, personal = quality.scorecard(raw_tables, issues), reduce(DataFrame.unionByName, personal)

    # Cleaned layer
    plan = clean.collect_plan(issues)
    cleaned, log = clean.clean_to(typed, plan, folder)
    columns = kept(_cleaned_profile(raw_columns, cleaned, plan, log, approximate))

    # Roles and KPIs
    bound = kept(roles.with_overrides(roles.assign_roles(roles.score_roles(columns)), columns, overrides or {}))
    binding = roles.bind(cleaned, columns, overrides, axis_values, bound)
    if domain is None:
        names = [c for df in tables.values() for c in df.columns]
        asked = spark.createDataFrame([(objective, names)], "objective string, names array<string>")
        domain = roles.infer_domain(asked, F.col("objective"), F.col("names")).first()["domain"]
    specs = instantiate(binding, domain)
    if not specs:
        measures = [(m["table_name"], m["column_name"], m["aggregation"], m["unit"]) for m in roles.model_measures(columns).collect()]
        keys = columns.where("is_candidate_pk or logical_type = 'identifier'").orderBy("table_name", "position").collect()
        specs = fallback(measures, [f"{k['table_name']}.{k['column_name']}" for k in keys])
    links = joins.collect_relationships(relations) if relations is not None else []
    results, (pareto, pairs, focus) = together(
        lambda: compute_kpis(cleaned, specs, binding, run_id, links, segments), lambda: _structure(cleaned, binding, run_id))
    kpis = kept(results.values)

    # Statistics and findings
    points, keys = series.complete_points(results.series), ("run_id", "kpi")
    trends, odd, seasons = together(
        lambda: kept(stats.linear_trend(points, keys)), lambda: settle(stats.anomalies(points, keys)), lambda: kept(stats.peak_trough(points, keys)))
    run = F.lit(run_id).alias("run_id")
    notes = _notes(decided, roles.unbound_notes(bound)).select(run, "*")
    parts = together(*[call for call in (
        lambda: insights.change_findings(kpis, trends), lambda: insights.level_findings(kpis), lambda: insights.trend_findings(kpis, trends),
        lambda: insights.anomaly_findings(kpis, odd, trends), lambda: insights.return_findings(kpis),
        lambda: insights.segment_findings(kpis, results.breakdown), lambda: insights.season_findings(kpis, seasons),
        lambda: insights.caveat_findings(notes),
        (lambda: insights.pareto_findings(pareto)) if pareto is not None else None,
        (lambda: insights.correlation_findings(pairs)) if pairs is not None else None,
    ) if call is not None])
    ranked = kept(insights.rank(insights.score(insights.all_findings(*parts))))

    # The rest is planned side by side and computed when it is asked for
    overall = quality.run_quality(scores).select(run, "overall_score")
    logged = log.select(run, "*")
    evaluation = (
        lambda: audit.formula_validity(kpis), lambda: audit.groundedness(ranked), lambda: audit.hallucination_rate(ranked),
        lambda: audit.type_resolution(decided), lambda: audit.binding_rate(kpis), lambda: audit.baseline_lift(kpis, columns))
    planned = {
        "dimensions": lambda: roles.model_dimensions(columns, axis_values), "dimensions_left_out": lambda: roles.left_out_dimensions(columns, axis_values),
        "measures": lambda: roles.model_measures(columns), "verdict": lambda: audit.verdict(kpis, overall),
        "audit_events": lambda: audit.kpi_events(kpis).unionByName(audit.finding_events(ranked)),
        "explanations": lambda: audit.explanations(kpis, logged, notes), "lineage_nodes": lambda: audit.lineage_nodes(kpis),
        "lineage_edges": lambda: audit.lineage_edges(kpis),
    }
    frames = together(*planned.values(), *evaluation)
    artefacts = {
        "type_decisions": decided, "column_profile": raw_columns, "table_profile": raw_tables, "pii": personal,
        "quality_issues": issues, "quality_scores": scores, "transformations": logged, "clean_column_profile": columns, "role_bindings": bound,
        "kpi_values": kpis, "kpi_series": results.series, "kpi_breakdown": results.breakdown,
        "trends": trends, "anomalies": odd, "seasonality": seasons, "insights": ranked,
        **dict(zip(planned, frames)), "evaluation": reduce(DataFrame.unionByName, frames[len(planned):]),
    }
    optional = {"join_candidates": relations, "pareto": pareto, "correlations": pairs, "concentration": focus}
    return {**artefacts, **{k: v for k, v in optional.items() if v is not None}}


def _profile(tables: Mapping[str, DataFrame], texts: Mapping[str, TextCounts | None], approximate: bool) -> tuple[DataFrame, DataFrame]:
    """Profiles of all tables, computed once: later steps read them many times."""
    repeats = reduce(DataFrame.unionByName, [duplicate_rows(df, n) for n, df in tables.items()])
    repeats, *profiles = together(
        lambda: kept(repeats), *[lambda n=n, df=df: kept(profile_columns(df, n, approximate=approximate, texts=texts.get(n))) for n, df in tables.items()])
    columns = reduce(DataFrame.unionByName, profiles)
    return columns, profile_tables(columns, repeats)


def _cleaned_profile(raw: DataFrame, cleaned: Mapping[str, DataFrame], plan: Sequence[clean.Step], log: DataFrame, approximate: bool) -> DataFrame:
    """The profile of the cleaned layer: a column that no step changed, in a table that lost no row, keeps its own."""
    lost = {r["table_name"] for r in log.where(F.col("operation").isin(*clean.ROW_STEPS) & (F.col("rows_affected") > 0)).collect()}
    touched: dict[str, list[str]] = {}
    for step in plan:
        own = cleaned[step.table_name].columns
        touched.setdefault(step.table_name, []).extend(own if step.table_name in lost else [c for c in own if c == step.column_name])
    touched = {t: list(dict.fromkeys(c)) for t, c in touched.items() if c}
    if not touched:
        return raw
    anew = together(*[lambda t=t, c=c: kept(profile_columns(cleaned[t].select(*[f"`{n}`" for n in c]), t, approximate=approximate)) for t, c in touched.items()])
    places = F.create_map(*[x for t, cs in touched.items() for c in cs for x in (F.lit(f"{t}.{c}"), F.lit(cleaned[t].columns.index(c)))])
    full = F.concat_ws(".", "table_name", "column_name")
    found = reduce(DataFrame.unionByName, anew).withColumn("position", places[full])
    return raw.where(~full.isin([f"{t}.{c}" for t, cs in touched.items() for c in cs])).unionByName(found)


def _notes(decisions: DataFrame, unbound: DataFrame) -> DataFrame:
    typed = decisions.select("table_name", "column_name", F.posexplode("warnings")).select(
        F.concat_ws("/", F.lit("0"), "table_name", "column_name", F.col("pos").cast("string")).alias("place"),
        F.concat_ws(": ", "column_name", "col").alias("note"))
    return typed.unionByName(unbound.select(F.concat_ws("/", F.lit("1"), "role").alias("place"), "note"))


def _structure(tables: Mapping[str, DataFrame], binding: roles.Binding, run_id: str):
    """Pareto, correlations and row concentration of the tables that have the columns for it."""
    measure = binding.roles.get("amount") or binding.roles.get("quantity")
    run = F.lit(run_id).alias("run_id")
    pareto, pairs, focus = None, [], None
    for name, df in tables.items():
        labels = [d.split(".", 1)[1] for d, k in binding.dimensions if k != "datetime" and d.startswith(f"{name}.")]
        if labels and measure and measure.startswith(f"{name}."):
            dimension, column = labels[first_dimension(df, [F.col(f"`{d}`") for d in labels]) or 0], measure.split(".", 1)[1]
            top = stats.pareto(df, dimension, column)
            pareto = top.where(F.col("rank") == 1).select(
                run, F.lit(dimension).alias("dimension_name"), F.lit(column).alias("measure_name"), "cutoff_count", "groups")
            focus = stats.row_concentration(df, dimension)
        if len(stats.numeric_columns(df)) > 1:
            pairs.append(stats.correlation_pairs(df).select(run, F.lit(name).alias("table_name"), "left", "right", "correlation"))
    return pareto, kept(reduce(DataFrame.unionByName, pairs)) if pairs else None, focus
