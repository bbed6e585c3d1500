from datetime import datetime

import pytest
from pyspark.sql import functions as F

from metricloom import fixed_values as fixed
from metricloom.functions.text import fixed_point, humanize
from metricloom.operators import audit, insights

KPI = ("run_id string, kpi string, name string, unit string, formula string, priority int, value double, previous_value double, current_value double, "
       "change_pct double, comparison_period timestamp_ntz, baseline_period timestamp_ntz, excluded_period timestamp_ntz, higher_is_better boolean, "
       "additivity string, status string, source string")


def kpi(slug="rev", value=100.0, change=None, better=True, name=None, additivity="additive", status="computed", priority=1):
    return ("r", slug, name or slug.title(), "currency", "SUM(x)", priority, value, 100.0, 100.0 * (1 + (change or 0)), change, datetime(2020, 2, 1),
            datetime(2020, 1, 1), None, better, additivity, status, "catalog")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), KPI)


def trends(spark, r2=0.33):
    return spark.createDataFrame([("r", "rev", 12, "up", 1.5, 0.0, r2)], "run_id string, kpi string, points bigint, direction string, slope double, intercept double, r2 double")


@pytest.mark.parametrize("change,better,basis,severity", [
    (0.10, True, None, "info"), (0.16, True, fixed.BASIS["favourable"], "info"), (-0.25, True, fixed.BASIS["adverse"], "warning"),
    (0.25, False, fixed.BASIS["adverse"], "warning"), (0.25, None, None, "warning")])
def test_change(spark, change, better, basis, severity):
    got = insights.change_findings(frame(spark, kpi(change=change, better=better)), trends(spark)).first()
    assert (got["recommendation_basis"], got["severity"], got["confidence"]) == (basis, severity, 0.85)
    assert f"{abs(change) * 100:.1f}%" in got["title"]
    if basis == fixed.BASIS["favourable"]:
        assert "R²=0.33" in got["recommendation"] and "weak" in got["recommendation"]


def test_level_and_trend(spark):
    k = frame(spark, kpi(value=1234567.0))
    assert insights.level_findings(k).first()["title"] == "Rev is 1,234,567 currency"
    assert insights.trend_findings(k, trends(spark)).first()["title"] == "Rev trends up across 12 periods"


def test_return_rate(spark):
    rows = [kpi("order_return_rate", 16.0, name="Order Return Rate"), kpi("returned_value", -893979.73)]
    got = insights.return_findings(frame(spark, *rows)).first()
    assert "16.0%" in got["title"] and "893,980" in got["recommendation"]
    assert insights.return_findings(frame(spark, kpi("order_return_rate", 4.9))).count() == 0


@pytest.mark.parametrize("top,category", [(30.0, None), (50.0, "finding"), (200.0, "risk")])
def test_segments(spark, top, category):
    parts = [("r", "rev", d, v, i + 1, 3, top + 57.0) for i, (d, v) in enumerate([("UK", top), ("FR", 29.0), ("ES", 28.0)])]
    b = spark.createDataFrame(parts, "run_id string, kpi string, dimension string, value double, rank int, segments bigint, total double")
    got = insights.segment_findings(frame(spark, kpi()), b).collect()
    assert [g["category"] for g in got] == ([category] if category else [])
    assert insights.segment_findings(frame(spark, kpi(additivity="non_additive")), b).count() == 0


def test_pareto_correlation_season_caveat(spark):
    p = spark.createDataFrame([("r", "country", "amount", 3, 3), ("r", "city", "amount", 2, 9)], "run_id string, dimension_name string, measure_name string, cutoff_count bigint, groups bigint")
    got = {g["metric"]: g["recommendation_basis"] for g in insights.pareto_findings(p).collect()}
    assert got == {"amount by country": None, "amount by city": fixed.BASIS["pareto"]}
    c = spark.createDataFrame([("r", "t", "a", "b", 0.49), ("r", "u", "a", "b", -0.8), ("r", "u", "a", "c", 0.6)], "run_id string, table_name string, left string, right string, correlation double")
    assert [g["title"] for g in insights.correlation_findings(c).collect()] == ["a and b move together (r = -0.80)"]
    s = spark.createDataFrame([("r", "rev", datetime(2020, 3, 1), 9.0, datetime(2020, 1, 1), 6.5, 12, 38.0)],
                              "run_id string, kpi string, peak_period timestamp_ntz, peak_value double, trough_period timestamp_ntz, trough_value double, periods bigint, amplitude_pct double")
    assert insights.season_findings(frame(spark, kpi()), s).first()["recommendation"] is None
    n = spark.createDataFrame([("r", str(i), f"col{i}: odd") for i in range(9)], "run_id string, place string, note string")
    assert insights.caveat_findings(n).count() == 9
    got = insights.caveat_findings(n, keep=6).collect()
    assert len(got) == 6 and {g["title"] for g in got} == {f"col{i}" for i in range(6)}


def test_strongest_anomaly_wins(spark):
    a = spark.createDataFrame([("r", "rev", datetime(2020, 1, 1), 0, 5.0, -2.6, "zscore"), ("r", "rev", datetime(2020, 2, 1), 1, 90.0, 3.1, "zscore"),
                               ("r", "rev", datetime(2020, 2, 1), 1, 90.0, None, "iqr")], "run_id string, kpi string, period timestamp_ntz, index int, value double, zscore double, method string")
    got = insights.anomaly_findings(frame(spark, kpi()), a, trends(spark)).collect()
    assert len(got) == 1 and got[0]["value"] == 90.0 and got[0]["recommendation_basis"] == "zscore outlier" and "other 11 periods" in got[0]["recommendation"]


def test_ranking_caps_interact(spark):
    fields = list(insights.FIELDS)
    def finding(i, kpi, basis, confidence, title=None, category="finding"):
        row = dict.fromkeys(fields)
        row.update(run_id="r", rule="x", kpi=kpi, metric=kpi, title=title or f"t{i}", description="", category=category, severity="info", confidence=confidence, grounded=True,
                   recommendation="do" if basis else None, recommendation_basis=basis, position=i)
        return tuple(row[f] for f in fields)
    rows = [finding(0, "a", "b1", 1.0), finding(1, "b", "b1", 0.9), finding(2, "a", "b1", 0.8), finding(3, "a", "b2", 0.7), finding(4, "a", "b3", 0.6),
            finding(5, "a", "b4", 0.5), finding(6, "c", None, 0.4, title="T0"), finding(7, None, None, 0.3)]
    rows += [finding(10 + i, f"k{i}", None, 0.1) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in insights.FIELDS.items()))
    got = [r["position"] for r in insights.rank(insights.score(df)).orderBy("rank").collect()]
    # 2 is over the rule cap and does not use up its metric; 5 is the metric's fourth; 6 repeats a title
    assert got[:5] == [0, 1, 3, 4, 7] and len(got) == 24


@pytest.mark.parametrize("turns", [1, 3, 512])
def test_ranking_in_rounds_is_the_fold(spark, monkeypatch, turns):
    import random

    monkeypatch.setattr(insights, "TURNS", turns)
    rng = random.Random(turns)
    rows = [(rng.choice(["r", "q", None]), rng.randrange(40), rng.choice(["A", "a", "B", "c", "D", "e", None]), rng.choice([None, "", "k1", "k2", "k3"]), rng.choice([None, "m"]),
             rng.choice([None, "", "x", "y", "z"]), float(rng.randrange(4))) for _ in range(120)]
    df = spark.createDataFrame(rows, "run_id string, position int, title string, kpi string, metric string, recommendation_basis string, score double")
    nulls = lambda row: tuple((x is not None, x if x is not None else 0) for x in row)
    want, reasons = [], []
    for run in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == run), key=lambda r: (-r[6], r[1], nulls(r[2:3]), nulls(r))):
            title, metric, basis = r[2] and r[2].lower(), r[3] or r[4] or None, r[5] or ""
            reason = ("same title" if title is not None and title in [k[0] for k in kept]
                      else "enough of its metric" if metric and [k[1] for k in kept].count(metric) >= 3
                      else "enough of its rule" if basis and [k[2] for k in kept].count(basis) >= 2
                      else "enough findings" if len(kept) >= 6 else None)
            if reason is None:
                kept.append((title, metric, basis))
                want.append((*r, len(kept)))
            reasons.append((*r, reason, None if reason else len(kept)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, insights.rank(df, in_all=6).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, insights.rank(df, in_all=6, left_out=True).collect()), key=key) == sorted(reasons, key=key)


def test_score(spark):
    got = insights.score(insights.change_findings(frame(spark, kpi(change=0.25)), trends(spark))).first()["score"]
    assert got == pytest.approx(0.6 + 0.75 + 0.85 * 0.5 + 0.3 + 0.25)


@pytest.mark.parametrize("metric,value,grounded", [
    ("Revenue", 104.0, True), ("revenue", 106.0, False), ("Net Revenue of shops", 100.0, True), ("profit", 100.0, False), ("", 100.0, False), (None, 1.0, False),
    ("orders", None, True), ("returns", 0.0, True), ("returns", 0.1, False), ("empty", 5.0, False), ("empty", None, True)])
def test_grounding(spark, metric, value, grounded):
    evidence = frame(spark, kpi("rev", 100.0, name="Net Revenue"), kpi("orders", 7.0, name="Orders", priority=2), kpi("ret", 0.0, name="Returns", priority=3), kpi("e", None, name="Empty", priority=4))
    claims = spark.createDataFrame([("r", metric, value)], "run_id string, metric string, value double")
    assert insights.ground_claims(claims, evidence).first()["grounded"] is grounded


@pytest.mark.parametrize("value", [9601159.72, 1000.0, 999.999, 12.5, 12.0, 1.005, 0.5, 0.090955, 0.12345678, 0.99996, 0.000123456, 0.00001234, 0.0, -3.25, -0.25, -12345.6, None])
def test_number_wording_is_that_of_prose(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    if value is None:
        expected = "n/a"
    elif abs(value) >= 1000:
        expected = f"{value:,.0f}"
    elif abs(value) >= 1:
        expected = f"{value:,.2f}".rstrip("0").rstrip(".")
    else:
        expected = f"{value:,.4g}"
    assert df.select(humanize(F.col("v"))).first()[0] == expected


def test_fixed_point_rounds_exact_values(spark):
    df = spark.createDataFrame([(0.125,), (12.25,), (-3.14159,)], "v double")
    assert [r[0] for r in df.select(fixed_point(F.col("v"), 1, signed=True)).collect()] == [f"{v:+.1f}" for v in (0.125, 12.25, -3.14159)]


@pytest.mark.parametrize("statuses,quality,status", [
    (["computed"] * 5, 80.0, "VALID"), (["computed", "null_result"], 80.0, "retry_semantic"), (["computed"] * 3 + ["null_result"] * 2, 40.0, "retry_quality"),
    (["null_result"] * 2, 40.0, "retry_semantic")])
def test_verdict(spark, statuses, quality, status):
    rows = [kpi(f"k{i}", 1.0 if s == "computed" else None, status=s) for i, s in enumerate(statuses)]
    q = spark.createDataFrame([("r", quality)], "run_id string, overall_score double")
    assert audit.verdict(frame(spark, *rows), q).first()["status"] == status


def test_evaluation(spark):
    k = frame(spark, kpi("a"), kpi("b", None, status="null_result"))
    assert audit.formula_validity(k).first()["score"] == 0.5 and audit.binding_rate(k).first()["score"] == 0.5
    none = spark.createDataFrame([], "grounded boolean")
    assert audit.groundedness(none).first()["score"] == 1.0 and audit.hallucination_rate(none).first()["score"] == 0.0
    d = spark.createDataFrame([("keep", "String"), ("keep", "int"), ("cast_numeric", "Float64"), ("parse_datetime", "Datetime")], "action string, target_type string")
    assert audit.type_resolution(d).first()["score"] == 0.75
