from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import series, slices, stats
from metricloom.operators.measures import Measure


def days(spark, n, start=datetime(2020, 1, 1)):
    return spark.createDataFrame([(start + timedelta(days=i), float(i)) for i in range(n)], "t timestamp_ntz, v double")


@pytest.mark.parametrize("n,grain", [(2, "hour"), (30, "day"), (300, "month"), (2000, "quarter"), (4000, "year"), (1, "month")])
def test_grain(spark, n, grain):
    assert series.time_range(days(spark, n), F.col("t")).grain == grain


def flags(spark, last, grain):
    df = spark.createDataFrame([(datetime(2020, 1, 1),), (last,)], "t timestamp_ntz")
    line = series.kpi_series(df, {"n": Measure.count()}, F.col("t"), grain)
    return line.orderBy(F.col("period").desc()).first()["partial"]


@pytest.mark.parametrize("last,grain,partial", [
    (datetime(2020, 3, 31), "month", False), (datetime(2020, 3, 29), "month", True), (datetime(2020, 12, 31), "quarter", False),
    (datetime(2020, 11, 30), "quarter", True), (datetime(2020, 3, 3, 23, 30), "day", False), (datetime(2020, 3, 3, 20), "day", True),
    (datetime(2020, 3, 1), "week", False), (datetime(2020, 2, 28), "week", True), (datetime(2020, 1, 1, 5, 59, 30), "hour", False)])
def test_partial_tail(spark, last, grain, partial):
    assert flags(spark, last, grain) is partial


def test_change_leaves_out_the_partial_tail(spark):
    rows = [("k", datetime(2020, 1, 1), 10.0, False), ("k", datetime(2020, 2, 1), 15.0, False), ("k", datetime(2020, 3, 1), 1.0, True),
            ("z", datetime(2020, 1, 1), 0.0, False), ("z", datetime(2020, 2, 1), 5.0, False)]
    df = spark.createDataFrame(rows, "kpi string, period timestamp_ntz, value double, partial boolean")
    got = {r["kpi"]: r for r in series.period_change(df).collect()}
    assert got["k"]["change_pct"] == 0.5 and got["k"]["excluded_period"] == datetime(2020, 3, 1)
    assert got["z"]["change_pct"] is None and got["z"]["excluded_period"] is None


def points(spark, *lines):
    rows = [(f"k{k}", datetime(2020, 1, 1) + timedelta(days=31 * i), float(v)) for k, line in enumerate(lines) for i, v in enumerate(line)]
    return spark.createDataFrame(rows, "kpi string, period timestamp_ntz, value double")


def test_anomalies_match_numpy(spark):
    rng = np.random.default_rng(1)
    line = list(rng.normal(10, 1, 20)) + [40.0]
    got = stats.anomalies(points(spark, line, [5.0] * 10, [1, 2, 90])).collect()
    z = (np.array(line) - np.mean(line)) / np.std(line, ddof=1)
    q1, q3 = np.percentile(line, [25, 75])
    expected = {("zscore", i) for i in range(21) if abs(z[i]) >= 2.5} | {
        ("iqr", i) for i in range(21) if not q1 - 1.5 * (q3 - q1) <= line[i] <= q3 + 1.5 * (q3 - q1)}
    assert {(r["method"], r["index"]) for r in got} == expected and all(r["kpi"] == "k0" for r in got)


def test_trend(spark):
    got = {r["kpi"]: r for r in stats.linear_trend(points(spark, [1, 2, 3, 4], [4, 3, 2, 1.5], [5, 5, 5], [1, 2])).collect()}
    assert [got[f"k{i}"]["direction"] for i in range(4)] == ["up", "down", "flat", "insufficient_data"]
    assert got["k0"]["slope"] == pytest.approx(1) and got["k0"]["r2"] == pytest.approx(1) and got["k3"]["slope"] is None


def test_peak_and_trough(spark):
    got = stats.peak_trough(points(spark, [3, 9, 1, 9, 1, 2], [1] * 6, [1, 2, 3])).collect()
    assert len(got) == 1
    assert (got[0]["peak_period"], got[0]["trough_period"], got[0]["amplitude_pct"]) == (datetime(2020, 2, 1), datetime(2020, 3, 3), 800.0)


def test_pareto_matches_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{int(g)}", float(v)) for g, v in zip(rng.zipf(1.6, 4000) % 500, rng.gamma(2, 5, 4000) - 3)]
    got = stats.pareto(spark.createDataFrame(rows, "g string, v double"), "g", "v").orderBy("rank").collect()
    sums = {}
    for g, v in rows:
        sums[g] = sums.get(g, 0) + v
    ordered = sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))
    share = np.cumsum([v for _, v in ordered]) / sum(sums.values())
    assert [r["dimension"] for r in got] == [g for g, _ in ordered[:25]]
    assert got[0]["cutoff_count"] == (share < 0.8).sum() + 1 and got[0]["groups"] == len(sums)
    assert [r["cumulative_share"] for r in got] == pytest.approx(list(share[:25]))


@pytest.mark.parametrize("values", [[1.0] * 400, [5.0] * 3 + [0.0] * 50 + [-1.0] * 4, [-2.0] * 9, [3.0, 3.0, 1.0, 1.0, 1.0, 1.0]])
def test_pareto_counts_inside_ties(spark, values):
    rows = [(f"g{i:03d}", v) for i, v in enumerate(values)]
    got = stats.pareto(spark.createDataFrame(rows, "g string, v double"), "g", "v", keep=2).collect()
    share = np.cumsum(sorted(values, reverse=True)) / sum(values)
    assert len(got) == 2 and got[0]["cutoff_count"] == (share < 0.8).sum() + 1 and got[0]["groups"] == len(values)


def test_correlation_skips_constants_and_short_pairs(spark):
    rows = [(float(i), float(-i), 1.0, float(i) if i < 5 else None) for i in range(30)]
    got = stats.correlation_pairs(spark.createDataFrame(rows, "a double, b double, c double, d double")).collect()
    assert [(r["left"], r["right"]) for r in got] == [("a", "b")] and got[0]["correlation"] == pytest.approx(-1)


def test_correlation_of_pairs_present_in_both(spark):
    """Nulls pair by pair, a common offset of ten digits, values that are no numbers, many tasks."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=3000)
    table = np.column_stack([base + rng.normal(size=3000) * k for k in range(6)]) + 3e9
    holes = rng.random(table.shape) < 0.2
    rows = [[None if gone else float(v) for v, gone in zip(r, g)] for r, g in zip(table, holes)]
    rows = [[*r, 0.1, float("nan") if i == 7 else float(i), float("inf") if i == 9 else 1.0 * i * i] for i, r in enumerate(rows)]
    names = [*(f"c{i}" for i in range(6)), "constant", "nan", "inf"]
    got = stats.correlation_pairs(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(9), keep=99).collect()
    # a row that is no number counts only against columns that have a value there
    spared = {(f"c{i}", name) for i in range(6) for name, row in (("nan", 7), ("inf", 9)) if holes[row, i]}
    assert spared and {(r["left"], r["right"]) for r in got} == spared | {(f"c{i}", f"c{j}") for i in range(6) for j in range(i + 1, 6)}
    for r in got:
        if r["right"] in ("nan", "inf"):
            continue
        a, b = int(r["left"][1]), int(r["right"][1])
        both = ~holes[:, a] & ~holes[:, b]
        assert r["rows"] == both.sum()
        assert r["correlation"] == pytest.approx(np.corrcoef(table[both, a] - 3e9, table[both, b] - 3e9)[0, 1], abs=1e-6)


def test_correlation_reads_a_wide_table_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    spark.createDataFrame(rng.normal(size=(50, 60)).tolist(), ", ".join(f"c{i} double" for i in range(60))).write.parquet(str(tmp_path / "t"))
    pairs = stats.correlation_pairs(spark.read.parquet(str(tmp_path / "t")), keep=5000)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and pairs.count() == 60 * 59 // 2


def test_row_concentration(spark):
    got = stats.row_concentration(spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "k string"), "k").first()
    assert (got["top_value"], got["share"], got["distinct_values"]) == ("a", 0.75, 2)


def test_slices(spark):
    df = days(spark, 100).withColumn("k", F.concat(F.lit("k"), (F.col("v") % 7).cast("int").cast("string")))
    total = Measure.sum("v")
    top = slices.slice_kpi(df, total, [slices.Filter("v", "gte", [50])], "k", limit=3).collect()
    assert len(top) == 3 and all(r["truncated"] for r in top)
    assert slices.slice_kpi(df, total, [slices.Filter("k", "contains", ["k1"])]).first()["value"] == sum(range(1, 100, 7))
    assert not slices.slice_kpi(df, total, [], "t", "month", 10).first()["truncated"]
    for bad in (slices.Filter("v", "between", [1]), slices.Filter("v", "eq"), slices.Filter("v", "about", [1])):
        with pytest.raises(ValueError):
            slices.predicate(df, bad)


def test_relative_range_runs_over_short_months():
    assert slices.month_bounds(datetime(2021, 3, 31, 5), 1) == ("2021-03-03", "2021-03-31")
    assert slices.month_bounds(datetime(2021, 1, 15), 3) == ("2020-10-15", "2021-01-15")
