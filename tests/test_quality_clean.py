import pytest

from metricloom.operators import clean, joins, profile, quality


@pytest.fixture(scope="module")
def tables(spark):
    orders = [("o1", "c1", "paid ", 30.0), ("o2", "c2", "", 30.0), ("o2", "c2", "", 30.0), ("o3", "c9", " open", -30.0), ("o4", None, "open", 5.0)]
    customers = [("c1", "Rome"), ("c2", " Oslo"), ("c3", "Bern")]
    return {"orders": spark.createDataFrame(orders, "order_id string, customer_id string, status string, amount double"),
            "customers": spark.createDataFrame(customers, "customer_id string, customer_city string")}


@pytest.fixture(scope="module")
def issues(tables):
    columns = [profile.profile_columns(df, n) for n, df in tables.items()]
    both = columns[0].unionByName(columns[1])
    repeats = [profile.duplicate_rows(df, n) for n, df in tables.items()]
    whole = profile.profile_tables(both, repeats[0].unionByName(repeats[1]))
    return whole, quality.quality_issues(both, whole, joins=joins.discover_joins(tables, min_overlap=0.2))


def found(issues):
    return {(r["table_name"], r["column_name"], r["issue_type"]): r for r in issues.collect()}


def test_issues(issues):
    got = found(issues[1])
    assert got["orders", None, "duplicates"]["severity"] == "high"
    assert got["orders", "status", "whitespace"]["rows_affected"] == 2  # the no-break space counts
    assert got["orders", "status", "empty_string"]["rows_affected"] == 2
    assert got["orders", "amount", "impossible_values"]["rows_affected"] == 1
    assert got["orders", "customer_id", "missing_values"]["severity"] == "medium"
    assert got["customers", "customer_city", "whitespace"]["evidence"]["example"] == " Oslo"


def test_scores(issues):
    scores = {r["table_name"]: r for r in quality.scorecard(*issues).collect()}
    o = scores["orders"]
    assert (o["completeness"], o["uniqueness"], o["consistency"], o["validity"], o["referential_integrity"]) == (95.0, 80.0, 85.0, 80.0, 85.0)
    assert o["overall"] == pytest.approx(0.3 * 95 + 0.2 * 80 + 0.2 * 85 + 0.2 * 80 + 0.1 * 85)  # one orphan key: c9
    assert quality.run_quality(quality.scorecard(*issues)).first()["tables"] == 2


def test_cleanup_follows_the_plan_and_counts(tables, issues, tmp_path):
    plan = clean.collect_plan(issues[1])
    assert [(s.operation, s.table_name, s.column_name) for s in plan] == [
        ("trim_whitespace", "customers", "customer_city"), ("drop_duplicates", "orders", None),
        ("trim_whitespace", "orders", "status"), ("empty_to_null", "orders", "status")]
    cleaned, log = clean.execute_plan(tables, plan)
    assert sorted(r["status"] or "-" for r in cleaned["orders"].collect()) == ["-", "open", "open", "paid"]
    assert [r["rows_affected"] for r in log.orderBy("step").collect()] == [1, 1, 2, 1]
    written, watched = clean.clean_to(tables, plan, str(tmp_path))
    assert sorted(map(tuple, watched.collect()), key=str) == sorted(map(tuple, log.collect()), key=str)
    assert sorted(map(str, written["orders"].collect())) == sorted(map(str, cleaned["orders"].collect()))


def test_explicit_steps(spark):
    df = spark.createDataFrame([("AbC", "1.5", "2020-01-02 03:04:05"), ("X", "x", "no"), (None, None, None)], "a string, b string, c string")
    steps = [clean.Step("drop_all_null_rows", "t"), clean.Step("normalize_case", "t", "a"), clean.Step("cast_numeric", "t", "b"),
             clean.Step("cast_datetime", "t", "c"), clean.Step("trim_whitespace", "t", "absent"), clean.Step("trim_whitespace", "other", "a")]
    cleaned, log = clean.execute_plan({"t": df}, steps)
    rows = cleaned["t"].orderBy("a").collect()
    assert [r["a"] for r in rows] == ["abc", "x"] and [r["b"] for r in rows] == [1.5, None] and rows[1]["c"] is None
    assert [r["rows_affected"] for r in log.orderBy("step").collect()] == [1, 2, 2, 2]


def test_counts_are_aggregates_of_rows(spark, tmp_path):
    """Copies count once, whatever the order of steps; no count comes from an accumulator, which a repeated task would add to twice."""
    rows = [(" a", "1")] * 4 + [("a", "1")] * 2 + [("", "2"), (None, None), (None, None), (" b ", None)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    step = lambda operation, column=None: clean.Step(operation, "t", column)
    plans = {
        "copies first": ([step("drop_duplicates"), step("trim_whitespace", "a"), step("empty_to_null", "a"), step("drop_all_null_rows")], [5, 2, 1, 1], 4),
        "copies last": ([step("trim_whitespace", "a"), step("empty_to_null", "a"), step("drop_duplicates")], [5, 1, 6], 4),
        "twice": ([step("drop_duplicates"), step("trim_whitespace", "a"), step("drop_duplicates"), step("normalize_case", "a")], [5, 2, 1, 4], 4),
        "empty rows first": ([step("drop_all_null_rows"), step("drop_duplicates"), step("trim_whitespace", "a")], [2, 4, 2], 4),
    }
    for name, (plan, want, left) in plans.items():
        cleaned, log = clean.execute_plan({"t": df}, plan)
        written, again = clean.clean_to({"t": df}, plan, str(tmp_path / name.replace(" ", "-")))
        counted = [r["rows_affected"] for r in log.orderBy("step").collect()]
        assert [r["rows_affected"] for r in again.orderBy("step").collect()] == counted
        assert sorted(map(str, written["t"].collect())) == sorted(map(str, cleaned["t"].collect()))
        assert "CollectMetrics" not in cleaned["t"]._jdf.queryExecution().optimizedPlan().toString()
        assert (name, counted, cleaned["t"].count()) == (name, want, left)


def test_join_overlap_is_exact(spark):
    left = spark.createDataFrame([(i % 300, i) for i in range(900)], "customer_id int, order_id int")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(100, 500)], "customer_id bigint, name string")
    got = {(r["source_column"], r["target_column"]): r for r in joins.discover_joins({"orders": left, "customers": right}, 0.2).collect()}
    r = got["customer_id", "customer_id"]
    assert (r["shared_values"], r["orphan_values"], r["overlap_ratio"], r["cardinality"]) == (200, 100, 0.6667, "many_to_one")
    assert r["validated"] and r["confidence"] == pytest.approx(0.75 * 200 / 300 + 0.1 * 300 / 900 + 0.15, abs=1e-4)
    strict = joins.discover_joins({"orders": left.drop("order_id"), "x": left.select("customer_id")}, require_unique_side=True)
    assert not strict.first()["validated"]


def test_many_pairs_take_several_aggregations(spark, monkeypatch):
    names = [f"customer_id_{i}" for i in range(7)]
    left = spark.createDataFrame([tuple(range(i, i + 7)) for i in range(50)], ", ".join(f"{n} int" for n in names))
    right = spark.createDataFrame([tuple(range(i, i + 7)) for i in range(25, 90)], ", ".join(f"{n} int" for n in names))
    shown = lambda: sorted(map(tuple, joins.discover_joins({"a": left, "b": right}, 0.1).collect()), key=str)
    whole = shown()
    monkeypatch.setattr(joins, "PAIRS_AT_ONCE", 4)
    assert len(whole) >= 7 and shown() == whole


def test_referential_issue(spark):
    left = spark.createDataFrame([(i,) for i in range(10)], "customer_id int")
    right = spark.createDataFrame([(i,) for i in range(3, 10)], "customer_id int")
    got = quality.referential_issues(joins.discover_joins({"a": left, "b": right})).first()
    assert (got["rows_affected"], got["severity"]) == (3, "high")
