import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions.text import like_literal
from metricloom.operators import measures
from metricloom.operators.joins import Relationship, join_tables
from metricloom.operators.measures import Measure, SpecError, check, evaluate, grouped


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("A1", "c1", 2, 10.0, "FR"), ("A1", "c1", 1, 4.0, "FR"), ("A2", "c2", 4, 5.0, "ES"),
            ("A3", None, 2, 10.0, "ES"), ("C4", "c2", -4, 2.0, None)]
    return spark.createDataFrame(rows, "invoice_no string, customer_id string, quantity int, unit_price double, country string").alias("sales")


REVENUE = "sales.quantity * sales.unit_price"


def one(df, measure, **kw):
    return evaluate(df, {"v": measure}, **kw).first()["v"]


def test_filtered_sums_reconcile(sales):
    net, gross = one(sales, Measure.sum(REVENUE)), one(sales, Measure.sum(REVENUE, "invoice_no NOT LIKE 'C%'"))
    returned = one(sales, Measure.sum(REVENUE, "quantity < 0"))
    assert (net, gross, returned) == (56.0, 64.0, -8.0)


def test_distinct_counts_skip_nulls(sales):
    assert one(sales, Measure.count_distinct("customer_id")) == 2
    assert one(sales, Measure.count()) == 5
    assert one(sales, Measure.count("customer_id")) == 4


def test_zero_divisor_gives_null(sales):
    assert one(sales, Measure.sum("quantity") / Measure.count(None, "quantity > 100")) is None
    assert one(sales, Measure.sum("quantity") / 0) is None


def test_arithmetic_between_measures(sales):
    q = Measure.sum("quantity")
    assert one(sales, 100 * q / Measure.count()) == 100.0
    assert one(sales, -(q - 1)) == -4.0
    assert one(sales, Measure.max("unit_price") - Measure.min("unit_price")) == 8.0
    assert one(sales, Measure.stddev("quantity", "quantity = 1")) is None


def test_breakdown_uses_the_same_expression_and_leaves_out_null(sales):
    rows = {r["dimension"]: r["value"] for r in grouped(sales, {"v": Measure.sum(REVENUE)}, F.col("country")).collect()}
    assert rows == {"FR": 24.0, "ES": 40.0}


def test_rank_ties_go_to_the_smaller_name(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "k string, v int")
    rows = grouped(df, {"v": Measure.sum("v")}, F.col("k"), limit=2).orderBy("rank").collect()
    assert [r["dimension"] for r in rows] == ["c", "a"]


def test_additivity():
    s, d, a = Measure.sum("x"), Measure.count_distinct("x"), Measure.avg("x")
    assert [m.additivity for m in (s, d, a, s + s, s - d, d + a, s / s, s * 2, -s)] == [
        "additive", "semi_additive", "non_additive", "additive", "semi_additive", "non_additive", "non_additive",
        "non_additive", "additive"]


def test_unknown_and_ambiguous_columns_are_errors(spark, sales):
    check(sales, {"ok": Measure.sum("SALES.Quantity")})
    with pytest.raises(SpecError):
        check(sales, {"bad": Measure.sum("sales.invented")})
    with pytest.raises(SpecError):
        check(sales, {"none": Measure._lift(3)})
    both = sales.join(spark.createDataFrame([("c1", 1)], "customer_id string, n int").alias("customers"),
                      F.col("sales.customer_id") == F.col("customers.customer_id"))
    with pytest.raises(SpecError):
        check(both, {"both": Measure.count("customer_id")})
    check(both, {"one": Measure.count("sales.customer_id")})


def test_like_takes_a_backslash_as_it_is(spark):
    df = spark.createDataFrame([("a\\b",), ("ab",)], "s string")
    assert df.where(like_literal(F.col("s"), "a\\%")).count() == 1


def test_median_matches_numpy_per_group_and_in_all(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=900).round(2), np.full(600, 0.25), [np.nan] * 3, rng.normal(size=101) * 1e6])
    keys = rng.integers(0, 5, len(values))
    rows = [(int(k), None if v != v else float(v)) for k, v in zip(keys, values)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    clean = [(k, v) for k, v in rows if v is not None]
    assert one(df, Measure.median("v")) == pytest.approx(np.median([v for _, v in clean]))
    got = {r["k"]: r["m"] for r in evaluate(df, {"m": Measure.median("v"), "n": Measure.count()}, {"k": F.col("k")}).collect()}
    for key in range(5):
        assert got[key] == pytest.approx(np.median([v for k, v in clean if k == key]))


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert one(df, Measure.sum("v")) is None


def test_joins_follow_validated_paths(spark):
    orders = spark.createDataFrame([(1, 10.0), (2, 5.0), (9, 1.0)], "id int, amount double")
    cities = spark.createDataFrame([(1, "Rome"), (2, "Oslo")], "id int, city string")
    t, link = {"orders": orders, "cities": cities}, [Relationship("orders", "id", "cities", "id")]
    with pytest.raises(SpecError):
        join_tables(t, ["orders", "cities"], [])
    first = join_tables(t, ["orders", "cities"], link)
    assert one(first, Measure.sum("orders.amount")) == 15.0  # base is the alphabetically first table
    own = join_tables(t, ["orders", "cities"], link, base="orders")
    assert one(own, Measure.sum("orders.amount")) == 16.0
    assert evaluate(own, {"v": Measure.sum("orders.amount")}, {"city": F.col("cities.city")}).count() == 2


def test_order_of_rows_does_not_matter(spark, sales):
    shuffled = sales.repartition(5, "unit_price").alias("sales")
    m = {"a": Measure.sum(REVENUE), "d": Measure.count_distinct("invoice_no")}
    assert evaluate(sales, m).collect() == evaluate(shuffled, m).collect()


@pytest.mark.parametrize("bits", [62, 2])
def test_conditional_distinct_counts_match_sets(spark, monkeypatch, bits):
    monkeypatch.setattr(measures, "MASK_BITS", bits)
    rng = np.random.default_rng(3)
    rows = [(int(g) if g else None, f"s{a}" if a else None, int(b), float(c), int(q)) for g, a, b, c, q in
            zip(rng.integers(0, 4, 900), rng.integers(0, 60, 900), rng.integers(-9, 9, 900), rng.choice([0.0, -0.0, 1.5, float("nan")], 900), rng.integers(-5, 5, 900))]
    df = spark.createDataFrame(rows, "g int, a string, b int, c double, q int").repartition(5)
    conditions = {"all": (None, lambda q: True), "low": ("q < 0", lambda q: q < 0), "top": ("q > 3", lambda q: q > 3), "none": ("q > 99", lambda q: False), "null": ("cast(null as boolean)", lambda q: False)}
    wanted = {f"{of}_{name}": Measure.count_distinct(of, text) for of in ("a", "b", "c", "a || b") for name, (text, _) in conditions.items()}
    value = {"a": lambda r: r[1], "b": lambda r: r[2], "c": lambda r: "nan" if r[3] != r[3] else r[3] + 0.0, "a || b": lambda r: r[1] and f"{r[1]}{r[2]}"}
    count = lambda rows, of, test: len({value[of](r) for r in rows if test(r[4]) and value[of](r) is not None})
    want = lambda rows: {f"{of}_{name}": count(rows, of, test) for of in value for name, (_, test) in conditions.items()}
    assert evaluate(df, wanted).first().asDict() == want(rows)
    got = evaluate(df, {**wanted, "n": Measure.count()}, {"g": F.col("g")})
    assert {r["g"]: {k: r[k] for k in wanted} for r in got.collect()} == {g: want([r for r in rows if r[0] == g]) for g in (1, 2, 3)}
    assert evaluate(df.where("false"), wanted).first().asDict() == dict.fromkeys(wanted, 0)


def test_conditions_of_a_distinct_count_share_one_row(spark, sales):
    """Four conditions over two columns give each row out twice, not eight times, and no expression is expanded."""
    found = {f"{c}{i}": Measure.count_distinct(c, f"quantity > {i}") for c in ("invoice_no", "customer_id") for i in range(4)}
    plan = evaluate(sales, found)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("inline") == 1 and plan.count("LocalRelation") + plan.count("LogicalRDD") == 1


def test_medians_of_a_base_share_their_counts(spark):
    df = spark.createDataFrame([(i % 3, float(i), float(-i * i) if i % 5 else None) for i in range(100)], "k int, v double, w double")
    asked = {"v": Measure.median("v"), "w": Measure.median("w", "k > 0"), "none": Measure.median("v", "k > 9")}
    got = evaluate(df, asked).first()
    assert got["v"] == 49.5 and got["none"] is None
    assert got["w"] == pytest.approx(np.median([-i * i for i in range(100) if i % 5 and i % 3]))
    by = {r["k"]: r["w"] for r in evaluate(df, asked, {"k": F.col("k")}).collect()}
    assert by[0] is None and by[1] == pytest.approx(np.median([-i * i for i in range(1, 100, 3) if i % 5]))


def test_distinct_values_of_all_groupings_take_one_shuffle(spark):
    """Total, few groups and too many groups for masks: the counts of each grouping by itself, also with nulls."""
    rows = [(None if i % 17 == 0 else i % 9, None if i % 13 == 0 else f"g{i % 45}", i % 1200, None if i % 7 == 0 else f"v{i % 31}", i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "few long, names string, many long, a string, b long")
    wanted = {"x": Measure.count_distinct("a").parts[0], "y": Measure.count_distinct("a", "b > 40").parts[0],
              "z": Measure.count_distinct("b", "few = 3").parts[0], "none": Measure.count_distinct("a", "b < 0").parts[0]}
    groupings = [{}, {"k": F.col("few")}, {"k": F.col("names")}, {"k": F.col("many")}]
    told = lambda frame: sorted(str(sorted(r.asDict().items(), key=str)) for r in frame.collect() if any(r[n] for n in wanted))
    found = measures.distinct_counts_by(df, groupings, wanted)
    for by, got in zip(groupings, found, strict=True):
        kept = df if not by else df.where(by["k"].isNotNull())
        own = measures.distinct_counts(kept, by, wanted)
        assert got.schema["x"].dataType == own.schema["x"].dataType
        assert told(got) == told(own) != []
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in found]
    assert ["Aggregate" in p for p in plans] == [False, False, False, True]
    empty = measures.distinct_counts_by(df.where("false"), groupings, wanted)
    assert [f.count() for f in empty] == [1, 0, 0, 0] and empty[0].first().asDict() == dict.fromkeys(wanted, 0)
