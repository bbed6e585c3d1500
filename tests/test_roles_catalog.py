import pytest
from pyspark.sql import functions as F

from metricloom.operators import catalog, profile, roles
from metricloom.operators.measures import evaluate


@pytest.fixture(scope="module")
def bound(retail):
    columns = profile.profile_columns(retail, "retail")
    return columns, roles.bind({"retail": retail}, columns)


def test_roles_and_returns(bound):
    binding = bound[1]
    assert {r: c.split(".")[1] for r, c in binding.roles.items() if r in ("quantity", "unit_price", "order_id", "customer_id", "product_id", "event_date", "geo")} == {
        "quantity": "Quantity", "unit_price": "UnitPrice", "order_id": "InvoiceNo", "customer_id": "CustomerID", "product_id": "StockCode",
        "event_date": "InvoiceDate", "geo": "Country"}
    assert binding.cancel_prefix == "C" and binding.has_negative_quantity
    assert len(set(binding.roles.values())) == len(binding.roles)


def test_identities(retail, bound):
    specs = catalog.instantiate(bound[1], "retail")
    v = evaluate(retail.alias("retail"), {s.slug: s.measure for s in specs}).first()
    assert v["gross_revenue"] + v["returned_value"] == pytest.approx(v["net_revenue"])
    assert v["order_count"] + v["cancelled_orders"] == retail.select("InvoiceNo").distinct().count()
    assert v["average_order_value"] == pytest.approx(v["gross_revenue"] / v["order_count"])
    assert v["transaction_lines"] == 49 and v["returned_value"] == -30.0
    assert [s.priority for s in specs] == sorted(s.priority for s in specs)


def test_gates(bound):
    slugs = lambda b, d: {s.slug for s in catalog.instantiate(b, d)}
    binding = bound[1]
    assert "gross_margin" not in slugs(binding, "retail")
    assert "gross_margin" in slugs(binding.with_overrides({"cost": "retail.UnitPrice"}), "retail")
    assert "net_revenue" not in slugs(binding, "energy") and "order_count" in slugs(binding, "energy")
    plain = roles.Binding({r: c for r, c in binding.roles.items() if r != "quantity"})
    assert slugs(plain, "retail").isdisjoint({"net_revenue", "gross_revenue", "returned_value", "units_sold", "order_return_rate"})
    amount = roles.Binding({"amount": "t.total", "order_id": "t.id"})
    named = {s.slug: s for s in catalog.instantiate(amount, "general")}
    assert named["net_revenue"].name == "Revenue" and named["net_revenue"].measure.text == "SUM(t.total)"
    assert named["order_count"].measure.text == "COUNT_DISTINCT(t.id)"


def test_negative_quantity_is_the_fallback_cancellation(bound):
    binding = roles.Binding({"quantity": "t.q", "unit_price": "t.p", "order_id": "t.id"}, None, True)
    text = {s.slug: s.measure.text for s in catalog.instantiate(binding, "retail")}
    assert text["cancelled_orders"] == "COUNT_DISTINCT(t.id WHERE t.q < 0)"
    assert text["gross_revenue"] == "SUM(t.q * t.p WHERE t.q >= 0)"


def test_fallback():
    measures, identifiers = [("t", f"m{i}", "SUM", None) for i in range(9)], ["t.a", "t.b", "t.c"]
    whole = [s.slug for s in catalog.fallback(measures, identifiers)]
    assert whole == [f"sum_m{i}" for i in range(9)] + ["distinct_a", "distinct_b", "distinct_c"]
    first = [s.slug for s in catalog.fallback(measures, identifiers, keep_measures=6, keep_identifiers=2)]
    assert first == [f"sum_m{i}" for i in range(6)] + ["distinct_a", "distinct_b"]


def test_prefix_on_most_ids_is_no_marker(spark):
    df = spark.createDataFrame([("A1", 1), ("A2", 1), ("3", 1)], "id string, q int")
    got = roles.returns_convention(df, "q", "id").first()
    assert got["cancel_prefix"] is None and not got["has_negative_quantity"]


def test_unbound_notes(bound):
    notes = {r["role"] for r in roles.unbound_notes(roles.assign_roles(roles.score_roles(bound[0]))).collect()}
    assert notes == {"amount"}


def test_domain(spark):
    rows = [("churn and arpu", []), ("", ["order_id", "customer_id"]), ("nothing here", []), ("", ["sku", "store", "basket"])]
    df = spark.createDataFrame(rows, "objective string, names array<string>")
    got = [r["domain"] for r in roles.infer_domain(df, F.col("objective"), F.col("names")).collect()]
    assert got == ["telecommunications", "ecommerce", "general", "retail"]


def test_axes_by_parameter_and_reasons(spark):
    rows = [("t", "few", "geo", 3, False, 0), ("t", "many", "categorical", 201, False, 1), ("t", "key", "geo", 9, True, 2), ("t", "day", "datetime", 999, False, 3), ("t", "text", "text", 5, False, 4)]
    columns = spark.createDataFrame(rows, "table_name string, column_name string, logical_type string, distinct_count long, is_candidate_pk boolean, position int")
    names = lambda df: {r["column_name"] for r in df.collect()}
    assert names(roles.chart_dimensions(columns)) == {"few", "day"} and names(roles.chart_dimensions(columns, 300)) == {"few", "many", "day"}
    assert {r["column_name"]: r["reason"] for r in roles.left_out_dimensions(columns).collect()} == {
        "many": "201 distinct values, more than 200", "key": "each row has a value of its own"}
    assert names(roles.left_out_dimensions(columns, 2)) == {"few", "many", "key"}
