"""Counted texts: fingerprints of long ones, exact decimals, what is shown, what is masked by length."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from metricloom.operators import counts, infer, pii, profile


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    head = "the same first words of a text that goes on for longer than the head of it does, " * 2
    rows = [head + str(rng.randint(0, 30)) for _ in range(300)] + ["short", "", " padded ", head, head + " "] * 3 + [None]
    rows += ["1" * 200, "1 " * 100 + "1", "007" + "1" * 200, "12/25/2020 " + "x" * 200, "a@b.co" + "m" * 200, "+49 170 1234567", "123e4567-e89b-12d3-a456-426614174000"]
    return rows, spark.createDataFrame([(t, "x") for t in rows], "t string, other string").repartition(4)


def test_long_texts_are_told_apart_and_shown_whole(texts):
    rows, df = texts
    found = counts.count_texts(df, ["t", "other"])
    kinds = Counter(t for t in rows if t is not None)
    assert found.long == {"t"} and found.rows.where("column_name = 't'").count() == len(kinds)
    assert max(len(r.value) for r in found.rows.collect()) <= counts.SHORT
    top = [(r.value, r.n) for r in found.first(10, F.col("n").desc()).where("column_name = 't'").orderBy("place").collect()]
    assert top == sorted(kinds.items(), key=lambda k: (-k[1], k[0]))[:10]
    low = [r.value for r in found.first(5).where("column_name = 't'").orderBy("place").collect()]
    assert low == sorted(kinds)[:5]


def test_tests_on_long_texts_are_those_on_texts(texts):
    rows, df = texts
    found = counts.count_texts(df, ["t"]).rows
    for name, test in counts.TESTS.items():
        got = found.agg(F.sum(F.when(counts.holds(name), F.col("n")).otherwise(0)).alias("n")).first()["n"]
        assert got == df.where(test(F.col("t"))).count(), name


def test_profile_of_long_texts(texts):
    rows, df = texts
    got = profile.profile_columns(df.select("t"), "x").first()
    kinds = Counter(t for t in rows if t is not None)
    assert got["distinct_count"] == len(kinds) + 1 and got["empty_count"] == 3
    assert [(t["value"], t["count"]) for t in got["top_values"]] == sorted(kinds.items(), key=lambda k: (-k[1], k[0]))[:10]
    assert got["sample_values"] == sorted(kinds)[:5]
    assert got["whitespace_example"] == min(t for t in kinds if t != t.strip())
    assert got["whitespace_count"] == sum(n for t, n in kinds.items() if t != t.strip())


def test_what_is_shuffled_does_not_grow_with_texts(spark):
    long = spark.createDataFrame([(str(i) * 20_000,) for i in range(10)], "t string")
    sizes = counts.count_texts(long, ["t"]).rows.select(F.length("value") + F.length("mark")).collect()
    assert max(r[0] for r in sizes) < 200


def test_decimals_are_counted_by_all_their_digits(spark):
    rows = [(Decimal(9007199254740993 + i), Decimal("1.10"), Decimal(f"0.{'0' * 28}{i}")) for i in range(6)]
    df = spark.createDataFrame(rows, "id decimal(20,0), price decimal(10,2), fine decimal(38,30)")
    got = {r["column_name"]: r for r in profile.profile_columns(df, "t").collect()}
    assert [got[c]["distinct_count"] for c in ("id", "price", "fine")] == [6, 1, 6]
    assert got["id"]["is_candidate_pk"] and not got["price"]["is_candidate_pk"]
    assert got["id"]["sample_values"] == [str(9007199254740993 + i) for i in range(5)]


def test_counts_are_taken_once_and_handed_on(spark, texts, monkeypatch):
    _, df = texts
    typed, decisions, found = infer.infer_with_counts(df, "x")
    assert {d.action for d in decisions} == {"keep"} and set(typed.columns) == {"t", "other"}
    monkeypatch.setattr(profile, "count_texts", lambda *a: pytest.fail("counted again"))
    monkeypatch.setattr(pii, "count_texts", lambda *a: pytest.fail("counted again"))
    assert profile.profile_columns(typed, "x", texts=found).count() == 2
    assert pii.detect_pii(typed, "x", found).count() == 0


def test_numbers_may_be_telephone_numbers_only_by_their_digits(spark):
    df = spark.createDataFrame([(12345678, 1234567, -23456789, 1.5, "")] * 3, "a long, b int, c int, d double, e string")
    assert {(r["column_name"], r["pii_type"]) for r in pii.detect_pii(df, "t").collect()} == {("a", "phone"), ("c", "phone")}


def test_wide_tables_take_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 7)
    df = spark.createDataFrame([tuple(range(12345670, 12345710))], ", ".join(f"c{i} long" for i in range(40)))
    assert pii.detect_pii(df, "t").count() == 40


def test_approximate_profiles_have_frequent_and_sample_values(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 2)] * 3 + [(None, 3)], "t string, n int")
    got = {r["column_name"]: r for r in profile.profile_columns(df, "t", approximate=True).collect()}
    assert [(t["value"], t["count"]) for t in got["t"]["top_values"]] == [("a", 5), ("b", 3)]
    assert got["t"]["sample_values"] == ["a"] and got["n"]["distinct_count"] == 3
