import os
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from compare import normal
from metricloom.functions.text import sanitize_name
from metricloom.plans import suite
from metricloom.plans.views import TABLES
from metricloom.sources import readers, writers

SMALL = "/root/testdata/sf0.001"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("text,delimiter", [("a,b\n1,2\n", ","), ("a;b;c\n1;2;3,5\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b\n1|2\n", "|"), ("a\n1\n", ",")])
def test_delimiter(spark, tmp_path, text, delimiter):
    assert readers.detect_delimiter(spark, write(tmp_path / "x.csv", text)) == delimiter


def test_csv(spark, tmp_path):
    path = write(tmp_path / "x.csv", "city;amount\nMálaga;1\nOrléans;\n", "latin-1")
    df = readers.read_table(spark, path, encoding="ISO-8859-1")
    assert [tuple(r) for r in df.collect()] == [("Málaga", "1"), ("Orléans", None)]
    assert readers.read_table(spark, path, n_rows=1, encoding="ISO-8859-1").count() == 1
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")


def test_layer_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "amount double")
    writers.write_layer({"1 sales": df}, str(tmp_path))
    assert writers.register_layer(spark, str(tmp_path), ["1 sales"]) == ["t_1_sales"]
    assert spark.table("t_1_sales").agg(F.sum("amount")).first()[0] == 6.0
    assert readers.metadata(df, "x").first()["row_count"] == 3 and sanitize_name("") == "t_"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    lines = ["InvoiceNo,StockCode,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"]
    for m in range(1, 13):
        for i in range(5):
            lines.append(f"{m * 10 + i},S{i},{i + 1},{m:02d}/{13 + i}/2020 10:30,{2.0 + i},{100 + i},{'France' if i < 4 else 'Spain'}")
    lines.append("C999,S1,-2,06/20/2020 09:00,3.0,101,France")
    raw = readers.read_table(spark, write(folder / "retail.csv", "\n".join(lines) + "\n"))
    return folder, suite.run_suite({"retail": raw}, "retail orders", "retail", str(folder / "clean"), run_id="r1")


def test_whole_run(run):
    _, out = run
    values = {r["kpi"]: r["value"] for r in out["kpi_values"].collect()}
    gross = sum((i + 1) * (2.0 + i) for i in range(5)) * 12
    assert values["gross_revenue"] == gross and values["net_revenue"] == gross - 6 and values["cancelled_orders"] == 1
    assert out["verdict"].first()["status"] == "VALID"
    dates = {r["column_name"]: r["format"] for r in out["type_decisions"].collect()}
    assert dates["InvoiceDate"] == "%m/%d/%Y %H:%M"
    assert out["kpi_series"].where("kpi = 'net_revenue'").count() == 12
    assert 0 < out["insights"].count() <= 24 and out["explanations"].count() == len(values)
    assert out["lineage_edges"].count() == 5 * len(values)


def test_sinks(spark, run):
    folder, out = run
    writers.write_catalogue_csv(out["kpi_values"].withColumn("error", F.lit("")), str(folder / "kpis"))
    assert spark.read.csv(str(folder / "kpis"), header=True).columns == list(writers.CATALOGUE_COLUMNS)
    writers.write_report({k: out[k] for k in ("verdict", "evaluation", "lineage_nodes")}, str(folder / "report"))
    assert sorted(os.listdir(folder / "report")) == ["evaluation", "lineage_nodes", "verdict"]


def test_fallback_run(spark):
    df = spark.createDataFrame([(i * 1.5, f"x{i % 4}") for i in range(60)], "alpha double, beta string")
    out = suite.run_suite({"plain": df}, "nothing", "general", run_id="r2")
    assert {"transaction_lines"} <= {r["kpi"] for r in out["kpi_values"].collect()}


def test_two_tables(spark):
    orders = spark.createDataFrame([(f"o{i}", f"c{i % 20}", datetime(2020, 1 + i % 12, 3), 10.0 + i % 7) for i in range(240)], "order_id string, customer_id string, order_date timestamp_ntz, amount double")
    customers = spark.createDataFrame([(f"c{i}", ["Rome", "Oslo", "Bern"][i % 3]) for i in range(20)], "customer_id string, customer_city string")
    out = suite.run_suite({"orders": orders, "customers": customers}, "orders revenue", "ecommerce", run_id="r3")
    values = {r["kpi"]: r["value"] for r in out["kpi_values"].collect()}
    assert values["net_revenue"] == sum(10.0 + i % 7 for i in range(240)) and values["unique_customers"] == 20
    assert out["join_candidates"].first()["validated"]
    named = out["kpi_breakdown"].groupBy("kpi").agg(F.count_distinct("dimension_name").alias("n"), F.count("dimension_name").alias("rows")).collect()
    assert named and {r["n"] for r in named} == {1}


def test_breakdown_passes_over_a_dimension_without_values(spark):
    from metricloom.operators import catalog, roles

    df = spark.createDataFrame([(None, "a", 1.0), (None, "b", 2.0)] * 9, "empty string, label string, v double")
    bound = roles.Binding({}, None, False, (("t.empty", "categorical"), ("t.label", "categorical")))
    out = suite.compute_kpis({"t": df}, catalog.fallback([("t", "v", "SUM", None)], []), bound, "r").breakdown.collect()
    assert [(r["dimension_name"], r["dimension"], r["value"]) for r in sorted(out, key=lambda r: r["rank"])] == [("t.label", "b", 18.0), ("t.label", "a", 9.0)]
    none = roles.Binding({}, None, False, (("t.empty", "categorical"), ("t.empty", "geo")))
    assert suite.compute_kpis({"t": df}, catalog.fallback([("t", "v", "SUM", None)], []), none, "r").breakdown.count() == 0


def test_approximate_run(spark):
    df = spark.createDataFrame([(i * 1.5, f"x{i % 4}") for i in range(60)], "alpha double, beta string")
    out = suite.run_suite({"plain": df}, "nothing", "general", run_id="r5", approximate=True)
    columns = {r["column_name"]: r for r in out["column_profile"].collect()}
    assert columns["beta"]["distinct_count"] == 4 and sorted(t["value"] for t in columns["beta"]["top_values"]) == ["x0", "x1", "x2", "x3"]
    assert out["kpi_values"].count() > 0


def test_cleaned_profile_keeps_untouched_columns(spark, monkeypatch):
    """Without lost rows only the columns that a step changed are profiled again, and stand in their place."""
    from metricloom.plans import suite as plan

    seen = []
    original = plan.profile_columns
    monkeypatch.setattr(plan, "profile_columns", lambda df, name, **kw: seen.append(df.columns) or original(df, name, **kw))
    df = spark.createDataFrame([(i, f" l{i % 3} ", f"c{i % 4}", 1.5 * i) for i in range(90)], "k int, label string, city string, v double")
    out = suite.run_suite({"t": df}, "nothing", "general", run_id="r4")
    assert seen == [["k", "label", "city", "v"], ["label"]]
    columns = {r["column_name"]: r for r in out["clean_column_profile"].collect()}
    assert [columns[c]["position"] for c in df.columns] == [0, 1, 2, 3] and columns["label"]["whitespace_count"] == 0
    assert out["column_profile"].where("column_name = 'label'").first()["whitespace_count"] == 90


def test_entry(spark):
    assert entry(spark).count() > 0


CHECKED = ["kpi_scalar_suite", "kpi_predicates", "kpi_median_stddev", "slice_filters", "relative_range", "returns_convention", "pareto", "linear_trend",
           "domain_inference", "clean_log", "kpi_period_change"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert normal(queries()[name](spark, SMALL).toPandas()) == normal(con.execute(oracle_sql()[name]).df())


def test_every_query_has_sql():
    from metricloom.plans.oracles import ORACLES
    from metricloom.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_quoted_line_breaks_and_ragged_lines(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    (tmp_path / "q.csv").write_text('id,note\n1,"line one\nline two"\n2,"say ""hi"", all"\n3,a,b,c\n4\n')
    rows = [tuple(r) for r in readers.read_table(spark, path).collect()]
    assert rows == [("1", "line one\nline two"), ("2", 'say "hi", all'), ("3", "a"), ("4", None)]
    assert tuple(readers.malformed(spark, path).first()) == (4, 2)
    semicolons = str(tmp_path / "s.csv")
    (tmp_path / "s.csv").write_text("a;b\n" + '"a, b, c, d";1\n' * 50)
    assert readers.detect_delimiter(spark, semicolons) == ";"
    df, decisions = readers.read_typed(spark, semicolons, "s")
    assert df.columns == ["a", "b"] and {d.column_name for d in decisions} <= {"a", "b"}


def test_shape_follows_quotes_over_lines_and_file_parts(spark, tmp_path):
    """Separators inside quotes that go on over line ends do not count, wherever a file part begins."""
    lines = ["a;b"] + [f'{i};"x,,,,\n,{i},\n,"",,"' for i in range(4000)]
    path = write(tmp_path / "x.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        shape = readers.csv_shape(spark, path)
        assert (shape.delimiter, shape.multi_line) == (";", True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    df = readers.read_table(spark, path)
    assert df.count() == 4000 and df.where(F.col("b") == F.concat(F.lit("x,,,,\n,"), "a", F.lit(',\n,",,'))).count() == 4000


def test_files_of_one_line_records_are_read_in_parts(spark, tmp_path):
    lines = ["id,note"] + [f'{i},"a ""quoted"", word {i}"' for i in range(6000)]
    path = write(tmp_path / "x.csv", "\n".join(lines) + "\n")
    assert not readers.csv_shape(spark, path).multi_line
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        parts, whole = readers.read_table(spark, path), readers.read_table(spark, path, multi_line=True)
        assert parts.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_callers_limit_holds(spark):
    from metricloom.operators.measures import Measure
    from metricloom.operators.slices import filter_options, slice_kpi

    df = spark.range(700).selectExpr("id", "cast(id as string) AS name")
    assert slice_kpi(df, Measure.sum("id"), dimension="name", limit=500).count() == 500
    rows = filter_options(df, [], ["name"], keep=3).collect()
    assert len(rows) == 3 and {(r.distinct_values, r.truncated) for r in rows} == {(700, True)}


def test_only_a_local_master_may_do_without_a_shared_folder():
    from types import SimpleNamespace

    from metricloom.session import checkpoint_dir

    nothing = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="local-cluster[2,1,1024]", getConf=lambda: nothing, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=context, conf=nothing))


def test_decimal_keys_beyond_doubles(spark):
    from metricloom.operators.joins import discover_joins

    big = 2**60
    a = spark.createDataFrame([(big + 2 * i,) for i in range(50)], "k long").selectExpr("cast(k as decimal(20,0)) AS order_id")
    b = spark.createDataFrame([(big + 2 * i + 1,) for i in range(50)], "k long").selectExpr("cast(k as decimal(20,0)) AS order_id")
    assert discover_joins({"a": a, "b": b}).count() == 0
    assert discover_joins({"a": a, "b": a}).first()["shared_values"] == 50


def test_overrides_reach_bindings_and_notes(spark):
    from metricloom.operators import roles

    schema = "role string, table_name string, column_name string, confidence double, reason string, logical_type string, distinct_count bigint, null_pct double, position int"
    found = spark.createDataFrame([("quantity", "t", "q", 0.9, "r", "quantity", 5, 0.0, 1)], schema)
    columns = found.selectExpr("table_name", "'d' AS column_name", "'datetime' AS logical_type", "distinct_count", "null_pct", "position")
    bound = roles.with_overrides(found, columns, {"event_date": "t.d"})
    assert {(r.role, r.column_name) for r in bound.collect()} == {("quantity", "q"), ("event_date", "d")}
    assert "event_date" not in {r.role for r in roles.unbound_notes(bound).collect()}


def test_ranking_keeps_by_title_metric_and_rule(spark):
    from metricloom.operators.insights import rank

    rows = [("r", i, t, k, m, b, s) for i, (t, k, m, b, s) in enumerate([
        ("A", "k1", "m", "x", 9.0), ("a", "k2", "m", "x", 8.0), ("B", "k1", "m", None, 7.0), ("C", "k1", "m", None, 6.0), ("D", "k1", "m", None, 5.0),
        ("E", None, None, "x", 4.0), ("F", None, None, "x", 3.0), ("G", None, None, None, 2.0)])]
    df = spark.createDataFrame(rows, "run_id string, position int, title string, kpi string, metric string, recommendation_basis string, score double")
    got = {r.title: (r.rank, r.reason) for r in rank(df, in_all=5, left_out=True).collect()}
    assert got == {"A": (1, None), "a": (None, "same title"), "B": (2, None), "C": (3, None), "D": (None, "enough of its metric"),
                   "E": (4, None), "F": (None, "enough of its rule"), "G": (5, None)}
    assert {r.title: r.rank for r in rank(df, in_all=2).collect()} == {"A": 1, "B": 2}
