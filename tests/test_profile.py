from datetime import date, datetime, timedelta

import numpy as np
import pytest

from metricloom.functions.text import mask_value
from metricloom.operators import pii, profile
from pyspark.sql import functions as F


def nearest(values, q):
    ordered = sorted(values)
    return ordered[int(np.floor((len(ordered) - 1) * q + 0.5))]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        hot = 7.5 if i % 3 == 0 else float(rng.normal(100, 30))  # a third of all rows share one value
        rows.append((i, hot, None if i % 4 == 0 else int(rng.integers(-5, 50)), f" v{i % 9}" if i % 10 == 0 else f"v{i % 9}",
                     datetime(2021, 1, 1) + timedelta(days=i % 400), i % 2 == 0))
    return rows, spark.createDataFrame(rows, "row_key int, price double, qty int, label string, created timestamp_ntz, flag boolean").repartition(6)


def test_quartiles_distinct_counts_and_outliers_match_brute_force(mixed):
    rows, df = mixed
    got = {r["column_name"]: r for r in profile.profile_columns(df, "t").collect()}
    for name, at in (("row_key", 0), ("price", 1), ("qty", 2)):
        values = [r[at] for r in rows if r[at] is not None]
        q1, q2, q3 = (nearest(values, q) for q in (0.25, 0.5, 0.75))
        assert (got[name]["q25"], got[name]["median"], got[name]["q75"]) == (q1, q2, q3)
        reach = 1.5 * (q3 - q1)
        assert (got[name]["outlier_count_iqr"] or 0) == sum(v < q1 - reach or v > q3 + reach for v in values)
        assert got[name]["distinct_count"] == len({r[at] for r in rows})  # null counts as a value
        assert got[name]["std"] == pytest.approx(np.std(values, ddof=1))
    label = got["label"]
    assert label["whitespace_count"] == 300 and label["whitespace_example"].startswith(" ")
    top = sorted(((-sum(r[3] == v for r in rows), v) for v in {r[3] for r in rows}))[:10]
    assert [(t["value"], t["count"]) for t in label["top_values"]] == [(v, -n) for n, v in top]
    assert got["created"]["granularity"] == "hour_or_finer" and got["created"]["logical_type"] == "datetime"
    assert got["flag"]["logical_type"] == "categorical" and got["row_key"]["is_candidate_pk"]
    assert got["qty"]["logical_type"] == "quantity" and got["qty"]["null_pct"] == 25.0


def test_exact_and_sketched_profiles_agree_roughly(mixed):
    _, df = mixed
    exact = {r["column_name"]: r for r in profile.profile_columns(df, "t").collect()}
    rough = {r["column_name"]: r for r in profile.profile_columns(df, "t", approximate=True).collect()}
    for name in exact:
        assert rough[name]["distinct_count"] == pytest.approx(exact[name]["distinct_count"], rel=0.15)
        assert rough[name]["whitespace_count"] == exact[name]["whitespace_count"]


def test_duplicates_are_counted_exactly(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (1, "b", 0.0), (2, None, 1.0), (2, None, 1.0), (2, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    got = profile.duplicate_rows(df, "t").first()
    assert (got["row_count"], got["duplicate_row_count"]) == (6, 3)


def test_table_score(spark):
    df = spark.createDataFrame([("o1", "c1", " paid", 30.0), ("o2", "c2", "paid", 30.0), ("o2", "c2", "paid", 30.0), ("o3", "c1", "open", 30.0)],
                               "order_id string, customer_id string, status string, amount double")
    columns = profile.profile_columns(df, "orders")
    table = profile.profile_tables(columns, profile.duplicate_rows(df, "orders")).first()
    assert table["duplicate_row_count"] == 1 and table["quality_score"] == 90.0
    assert table["warnings"] == ["1 duplicate rows detected"]


@pytest.mark.parametrize("step,label", [(timedelta(hours=1), "hour_or_finer"), (timedelta(days=1), "day"), (timedelta(days=7), "week"),
                                        (timedelta(days=30), "month"), (timedelta(days=365), "year")])
def test_granularity(spark, step, label):
    rows = [(datetime(2000, 1, 1) + step * i,) for i in range(20)]
    assert profile.date_granularity(spark.createDataFrame(rows, "t timestamp_ntz"), ["t"]).first()["granularity"] == label


def test_two_dates_are_too_few(spark):
    df = spark.createDataFrame([(date(2020, 1, 1),), (date(2020, 1, 2),)], "d date")
    assert profile.date_granularity(df, ["d"]).first()["granularity"] == "unknown"


def test_hint_modes(spark):
    df = spark.createDataFrame([(0.1 * i, i % 7) for i in range(50)], "discount double, item_count int")
    loose = {r["column_name"]: r["logical_type"] for r in profile.profile_columns(df, "t").collect()}
    words = {r["column_name"]: r["logical_type"] for r in profile.profile_columns(df, "t", hint_mode="token").collect()}
    assert loose == {"discount": "quantity", "item_count": "quantity"}
    assert words == {"discount": "numeric", "item_count": "quantity"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, s string, t timestamp_ntz")
    got = {r["column_name"]: r for r in profile.profile_columns(df, "t").collect()}
    assert got["a"]["distinct_count"] == 0 and got["a"]["q50"] is None and got["s"]["row_count"] == 0
    table = profile.profile_tables(profile.profile_columns(df, "t"), profile.duplicate_rows(df, "t")).first()
    assert table["warnings"] == ["Table is empty"]


def test_pii(spark):
    df = spark.createDataFrame([("a@b.co", "+33 6 12 34 56 78", "x", "Rue 1", 5), ("c@d.org", "0612345678", "y", "Rue 2", 6), ("", None, "z", "Rue 3", 7)],
                               "contact string, line string, first_name string, street string, n int")
    got = {r["column_name"]: (r["pii_type"], r["confidence"]) for r in pii.detect_pii(df, "t").collect()}
    assert got == {"contact": ("email", 0.95), "line": ("phone", 0.85), "first_name": ("name", 0.7), "street": ("address", 0.7)}


@pytest.mark.parametrize("value,kind,masked", [
    ("anna@x.org", "email", "a***@x.org"), ("@x.org", "email", "***@x.org"), ("+33 612-345", "phone", "***2345"), ("12", "phone", "***"), ("no at", "email", "n***t"),
    ("ab", "name", "***"), ("Anna", "name", "A***a"), (None, "name", "")])
def test_masking(spark, value, kind, masked):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(mask_value(F.col("v"), kind)).first()[0] == masked


def test_facts_of_texts_are_not_sorted(spark):
    """Only padded texts are sorted for the least of them; every other fact merges by column."""
    df = spark.createDataFrame([(" b",), ("a",), ("a",), ("",), ("x@y.org",), (None,)], "t string")
    facts, example = profile._text_facts(profile.count_texts(df, ["t"]))
    assert "SortAggregate" not in facts._jdf.queryExecution().executedPlan().toString()
    row = facts.first()
    assert (row.distinct_values, row.whitespace_count, row.empty_count, row.email_share) == (4, 1, 1, 0.2)
    assert example.first().whitespace_example == " b"
    whole = profile.profile_columns(df, "t").first()
    assert (whole.distinct_count, whole.whitespace_example) == (5, " b")
