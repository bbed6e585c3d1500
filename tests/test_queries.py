from datetime import datetime

import pytest

from metricloom.plans import queries, suite, views


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime(2001, 5, 6)
    made = {
        "lineitem": spark.createDataFrame([(i // 2, i % 5, i % 3, 2.0 + i, 10.0 * i + 1, 0.1, 0.05) for i in range(40)],
                                          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "orders": spark.createDataFrame([(i, i % 4, "F", 5.0, day) for i in range(20)],
                                        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"),
        "customer": spark.createDataFrame([(i, i % 2, "BUILDING") for i in range(4)], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "nation": spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_the_sales_view_is_joined_once_a_query(spark, folder, monkeypatch):
    """Profile, KPIs, Pareto and correlations of one query read written rows, not four joined tables each."""
    joined, read = [], []
    sales, profiled, computed = views.sales, queries.profile.profile_columns, suite.compute_kpis
    monkeypatch.setattr(views, "sales", lambda *a: joined.append(1) or sales(*a))
    monkeypatch.setattr(queries.profile, "profile_columns", lambda df, *a, **k: read.append(df) or profiled(df, *a, **k))
    monkeypatch.setattr(suite, "compute_kpis", lambda tables, *a, **k: read.append(tables["sales"]) or computed(tables, *a, **k))
    assert queries.QUERIES["insights_advice"](spark, folder).count() > 0
    assert len(joined) == 1 and len(read) == 2
    assert all("/settled-" in f for df in read for f in df.inputFiles())


def test_the_sales_view_writes_factors_and_has_the_rows_of_its_sql(spark, folder):
    """What is written are the tables' own columns; the view's text and the joins in another order give the same rows."""
    written = []
    found = views.sales(spark, folder, lambda joined: written.append(joined) or joined)
    assert not {"unit_price", "cost", "discount", "freight", "order_id"} & set(written[0].columns)
    told = views.view(spark, folder, views.SALES)
    assert found.schema == told.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, told.collect())) != []
