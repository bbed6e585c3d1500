"""Quality issues and scores, derived from profiles, type decisions and join candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("table_name", "column_name", "issue_type", "severity", "rows_affected",
          "detection_method", "recommended_action", "evidence")

# Caps and weights of the scores.
WHITESPACE_CAP, EMPTY_CAP, IMPOSSIBLE_PENALTY = 15.0, 10.0, 10.0
REFERENCE_PENALTY, REFERENCE_CAP = 15, 80
WEIGHTS = {"completeness": 0.3, "uniqueness": 0.2, "consistency": 0.2, "validity": 0.2, "referential_integrity": 0.1}


def _evidence(**facts: Column) -> Column:
    return F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v.cast("string"))])


def _issue(kind: str, severity, rows: Column, method, action, evidence: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("issue_type"), lit(severity).alias("severity"), rows.cast("bigint").alias("rows_affected"),
        lit(method).alias("detection_method"), lit(action).alias("recommended_action"),
        (evidence if evidence is not None else F.create_map().cast("map<string,string>")).alias("evidence"),
    )


def _explode(df: DataFrame, *issues: Column) -> DataFrame:
    named = df if "column_name" in df.columns else df.withColumn("column_name", F.lit(None).cast("string"))
    return named.select("table_name", "column_name", F.inline(F.array_compact(F.array(*issues)))).select(*FIELDS)


def column_issues(columns: DataFrame) -> DataFrame:
    rows = F.greatest("row_count", F.lit(1))
    missing = F.col("null_pct")
    return _explode(
        columns,
        F.when(missing >= 5, _issue(
            "missing_values", F.when(missing < 20, "low").when(missing < 50, "medium").otherwise("high"),
            F.col("null_count"), "null_count",
            "Leave nulls as they are unless a default is justified, and record any imputation.",
            _evidence(null_pct=missing))),
        F.when(F.col("whitespace_count") > 0, _issue(
            "whitespace", "low", F.col("whitespace_count"), "trim comparison",
            "Trim leading and trailing white space.", _evidence(example=F.col("whitespace_example")))),
        F.when(F.col("empty_count") > 0, _issue(
            "empty_string", "low", F.col("empty_count"), "empty string count", "Read empty strings as nulls.")),
        F.when((F.col("logical_type") == "currency") & (F.col("min") < 0), _issue(
            "impossible_values", "medium", F.col("negative_count"), "domain rule: currency >= 0",
            "Look into negative money values before summing them.")),
        F.when((F.col("logical_type") == "quantity") & (F.col("negative_count") > 0), _issue(
            "returns_present", "medium", F.col("negative_count"), "negative quantity count",
            "Treat these rows as returns and report gross and net apart.",
            _evidence(negative_rows=F.col("negative_count"), share=F.round(F.col("negative_count") / rows, 6)))),
        F.when(F.col("outlier_count_iqr") > 0, _issue(
            "outliers", "low", F.col("outlier_count_iqr"), "IQR 1.5",
            "Never dropped automatically. Review the distribution before filtering.",
            _evidence(outlier_count=F.col("outlier_count_iqr")))),
    )


def duplicate_issues(tables: DataFrame) -> DataFrame:
    share = F.col("duplicate_row_count") / F.greatest("row_count", F.lit(1))
    return _explode(tables, F.when(F.col("duplicate_row_count") > 0, _issue(
        "duplicates", F.when(share < 0.05, "medium").otherwise("high"), F.col("duplicate_row_count"),
        "full-row uniqueness", "Review exact duplicate rows and drop them where they are errors.",
        _evidence(duplicate_row_count=F.col("duplicate_row_count")))))


def decision_issues(decisions: DataFrame) -> DataFrame:
    """What typing cost: unparsed dates, values left as text, dates in an unproven order."""
    dated, rate = F.col("action") == "parse_datetime", F.coalesce("parse_rate", F.lit(1.0))
    unsure = F.exists("warnings", lambda w: w.contains("Ambiguous date order"))
    rejected = F.to_json("rejected")
    return _explode(
        decisions,
        F.when(dated & (rate < 1), _issue(
            "unparsed_dates", F.when(rate < 0.99, "high").otherwise("low"), F.lit(0),
            F.concat(F.lit("date format inference ("), F.col("format"), F.lit(")")),
            "Look for mixed date formats at the source; unparsed values are null and drop out of every series.",
            _evidence(format=F.col("format"), parse_rate=F.col("parse_rate"), rejected_candidates=rejected))),
        F.when((F.size("warnings") > 0) & (F.col("action") == "keep") & (F.col("parse_rate") > 0), _issue(
            "ambiguous_type", "low", F.lit(0), "schema inference", F.concat_ws("; ", "warnings"),
            _evidence(parse_rate=F.col("parse_rate"), reason=F.col("reason")))),
        F.when(dated & unsure, _issue(
            "ambiguous_date_order", "high", F.lit(0), "day/month component analysis",
            "Confirm the date convention at the source; the values fit both orders.",
            _evidence(format=F.col("format"), rejected_candidates=rejected))),
    )


def referential_issues(joins: DataFrame) -> DataFrame:
    """Distinct source values absent from the target of a validated join, counted exactly."""
    share = F.col("orphan_values") / F.greatest("source_distinct", F.lit(1))
    source = F.concat_ws(".", "source_table", "source_column")
    target = F.concat_ws(".", "target_table", "target_column")
    named = joins.where("validated").withColumns(
        {"table_name": F.col("source_table"), "column_name": F.col("source_column")}
    )
    return _explode(named, F.when(F.col("orphan_values") > 0, _issue(
        "referential_integrity", F.when(share < 0.1, "medium").otherwise("high"), F.col("orphan_values"),
        "join overlap", F.concat(F.lit("Look into keys of "), source, F.lit(" missing from "), target, F.lit(".")),
        _evidence(target=target, overlap_ratio=F.col("overlap_ratio")))))


def quality_issues(
    columns: DataFrame, tables: DataFrame, decisions: DataFrame | None = None, joins: DataFrame | None = None
) -> DataFrame:
    issues = column_issues(columns).unionByName(duplicate_issues(tables))
    if decisions is not None:
        issues = issues.unionByName(decision_issues(decisions))
    if joins is not None:
        issues = issues.unionByName(referential_issues(joins))
    return issues


def scorecard(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """Five axes and their weighted total per table."""
    of = lambda kind: F.col("issue_type") == kind
    sized = issues.join(tables.select("table_name", F.greatest("row_count", F.lit(1)).alias("_rows")), "table_name")
    pct = F.col("rows_affected") * 100.0 / F.col("_rows")
    penalties = sized.groupBy("table_name").agg(
        F.sum(F.when(of("whitespace"), F.least(F.lit(WHITESPACE_CAP), pct)).otherwise(0.0)).alias("_consistency"),
        F.sum(F.when(of("empty_string"), F.least(F.lit(EMPTY_CAP), pct))
              .when(of("impossible_values"), IMPOSSIBLE_PENALTY).otherwise(0.0)).alias("_validity"),
        F.count_if(of("referential_integrity")).alias("_references"),
    )
    rows = F.greatest("row_count", F.lit(1))
    cells = rows * F.greatest("column_count", F.lit(1))
    lost = lambda c: F.coalesce(c, F.lit(0))
    axes = {
        "completeness": 100 * (1 - F.col("null_cells") / cells),
        "uniqueness": 100 * (1 - F.col("duplicate_row_count") / rows),
        "consistency": F.greatest(F.lit(0.0), 100 - lost(F.col("_consistency"))),
        "validity": F.greatest(F.lit(0.0), 100 - lost(F.col("_validity"))),
        "referential_integrity": 100.0 - F.least(F.lit(REFERENCE_CAP), REFERENCE_PENALTY * lost(F.col("_references"))),
    }
    overall = sum(axes[a] * w for a, w in WEIGHTS.items())
    return tables.join(penalties, "table_name", "left").select(
        "table_name", F.round(overall, 2).alias("overall"), *[F.round(c, 2).alias(a) for a, c in axes.items()]
    )


def run_quality(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("overall"), 2).alias("overall_score"), F.count(F.lit(1)).alias("tables"))
