"""Named queries over the driver tables, one per operator or group of operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.text import humanize, mask_value
from metricloom.operators import (
    audit, catalog, clean, counts, infer, insights, joins, pii, profile, quality, roles, series, slices, stats,
)
from metricloom.operators.measures import Measure, evaluate, grouped, spec_problems, to_long
from metricloom.plans import suite, views
from metricloom.session import checkpoint_dir, configure, kept, settle, together
from metricloom.sources import readers, writers
from metricloom.sources.readers import metadata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SETTLED: dict[str, object] = {}

BINDING = roles.Binding(
    roles={
        "quantity": "sales.quantity", "unit_price": "sales.unit_price", "cost": "sales.cost",
        "discount": "sales.discount", "freight": "sales.freight", "order_id": "sales.order_id",
        "customer_id": "sales.customer_id", "product_id": "sales.product_id", "event_date": "sales.order_ts",
        "geo": "sales.country", "category": "sales.segment", "status": "sales.status",
    },
    cancel_prefix="C", has_negative_quantity=True,
    dimensions=(("sales.order_ts", "datetime"), ("sales.country", "geo"), ("sales.segment", "categorical"),
                ("sales.status", "categorical")),
)
RUN = "run-1"


def query(fn: Query) -> Query:
    def configured(spark: SparkSession, folder: str) -> DataFrame:
        _SETTLED.clear()  # what a query's parts share is computed anew for every query
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = configured
    return configured


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Counts and ranks as 64-bit integers."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def floating(df: DataFrame, *columns: str) -> DataFrame:
    """Nullable counts as doubles, so that every client shows nulls alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def text(*columns: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def sales(spark, folder):
    return views.sales(spark, folder).alias("sales")


def sales_rows(spark, folder) -> DataFrame:
    """The sales view joined once and written, for queries that read it many times."""
    if "sales rows" not in _SETTLED:
        _SETTLED["sales rows"] = views.sales(spark, folder, settle)
    return _SETTLED["sales rows"]


def catalogue(domain: str = "retail") -> list[catalog.KpiSpec]:
    return catalog.instantiate(BINDING, domain)


def measures(*slugs: str, domain: str = "retail") -> dict[str, Measure]:
    return {s.slug: s.measure for s in catalogue(domain) if not slugs or s.slug in slugs}


# --- KPIs ------------------------------------------------------------------


@query
def kpi_scalar_suite(spark, folder):
    kpis = measures()
    return rounded(to_long(evaluate(sales(spark, folder), kpis), [], list(kpis)), 2, "value")


@query
def kpi_freight_discount(spark, folder):
    kpis = {**measures("freight_cost", domain="transport"), **measures("discount_given", domain="marketing")}
    return rounded(to_long(evaluate(sales(spark, folder), kpis), [], list(kpis)), 2, "value")


@query
def kpi_catalogue(spark, folder):
    """Catalogue entries with their values: names, units, additivity."""
    specs = catalogue()
    kpis = {s.slug: s.measure for s in specs}
    values = to_long(evaluate(sales(spark, folder), kpis), [], list(kpis))
    listed = catalog.catalogue_frame(spark, specs).select(
        F.col("slug").alias("kpi"), "name", "unit", "additivity", "priority", "higher_is_better")
    return rounded(listed.join(values, "kpi"), 2, "value")


@query
def kpi_fallback(spark, folder):
    """Plain sums, averages and distinct counts where no role matches."""
    specs = catalog.fallback(
        [("events", "value", "AVG", None), ("events", "user_id", "SUM", None)], ["events.event_id", "events.event_type"])
    events = views.tables(spark, folder, "events")["events"].alias("events")
    kpis = {s.slug: s.measure for s in specs}
    return rounded(to_long(evaluate(events, kpis), [], list(kpis)), 4, "value")


@query
def kpi_quoted_names(spark, folder):
    """The suite over a table and columns whose names need quotes in SQL."""
    names = {"order_id": "Invoice No", "quantity": "Units", "unit_price": "Unit Price", "customer_id": "customer-id", "order_ts": "When?", "product_id": "`sku`"}
    table = views.sales(spark, folder).withColumnsRenamed(names)
    bound = {role: f"my-sales.{names.get(ref.split('.')[1], ref.split('.')[1])}" for role, ref in BINDING.roles.items()}
    specs = catalog.instantiate(roles.Binding(bound, BINDING.cancel_prefix, True), "retail")
    kpis = {s.slug: s.measure for s in specs}
    base = joins.join_tables({"my-sales": table}, specs[0].tables, [])
    return rounded(to_long(evaluate(base, kpis), [], list(kpis)), 2, "value")


@query
def kpi_segment_totals(spark, folder):
    """Leading segments with the number and total of all segments, far more than those kept."""
    parts = grouped(sales(spark, folder), measures("net_revenue", "units_sold"), F.col("sales.product_id"), limit=suite.SEGMENTS, totals=True)
    return whole(rounded(parts, 2, "value", "total"), "rank", "segments")


@query
def kpi_by_segment(spark, folder):
    kpis = measures("net_revenue", "order_count", "average_order_value", "order_return_rate")
    return whole(rounded(grouped(sales(spark, folder), kpis, F.col("sales.country"), limit=suite.SEGMENTS), 2, "value"), "rank")


@query
def kpi_series_quarter(spark, folder):
    kpis = measures("net_revenue", "returned_value", "order_count", "average_order_value", "unique_customers")
    line = series.kpi_series(sales(spark, folder), kpis, F.col("sales.order_ts"))
    return rounded(line.select("kpi", *text("period"), "value", "partial"), 2, "value")


@query
def kpi_period_change(spark, folder):
    kpis = measures("net_revenue", "order_count", "units_sold")
    line = series.kpi_series(sales(spark, folder), kpis, F.col("sales.order_ts"))
    changed = series.period_change(line)
    periods = ("comparison_period", "baseline_period", "excluded_period")
    shown = changed.select("kpi", "current_value", "previous_value", "change_pct", *text(*periods))
    return rounded(rounded(shown, 2, "current_value", "previous_value"), 6, "change_pct")


def _event_series(spark, folder, grain):
    events = views.tables(spark, folder, "events")["events"]
    kpis = {"events": Measure.count(), "users": Measure.count_distinct("user_id"), "value": Measure.sum("value")}
    line = series.kpi_series(events, kpis, F.col("ts"), grain)
    return rounded(line.select("kpi", *text("period"), "value", "partial"), 4, "value")


@query
def kpi_series_daily(spark, folder):
    return _event_series(spark, folder, None)


@query
def kpi_series_hourly(spark, folder):
    return _event_series(spark, folder, "hour")


@query
def kpi_series_weekly(spark, folder):
    return _event_series(spark, folder, "week")


@query
def kpi_predicates(spark, folder):
    """Every kind of condition inside an aggregate, over two joined tables."""
    t = views.tables(spark, folder, "lineitem", "part")
    base = joins.join_tables(t, ["lineitem", "part"], [joins.Relationship("lineitem", "l_partkey", "part", "p_partkey")])
    kpis = {
        "returned": Measure.sum("l_quantity", "l_returnflag = 'R'"),
        "not_returned": Measure.sum("l_quantity", "NOT l_returnflag = 'R'"),
        "cheap_or_small": Measure.count(None, "(l_extendedprice < 1000 OR p_size <= 3) AND l_discount >= 0.05"),
        "rings": Measure.count_distinct("l_partkey", "p_name LIKE '%ring'"),
        "no_rings": Measure.count_distinct("l_partkey", "p_name NOT LIKE '%r_ng'"),
        "some_brands": Measure.avg("l_extendedprice", "p_brand IN ('Brand#1', 'Brand#12', 'Brand#21')"),
        "other_brands": Measure.avg("l_extendedprice", "p_brand NOT IN ('Brand#1', 'Brand#12')"),
        "known": Measure.count("l_tax", "p_type IS NOT NULL"),
        "unknown": Measure.count("l_tax", "p_type IS NULL"),
        "nothing": Measure.sum("l_quantity", "l_quantity > 1000") / Measure.count(None, "l_quantity > 1000"),
        "spread": Measure.max("l_extendedprice") - Measure.min("l_extendedprice"),
        "negated": -Measure.sum("l_tax * (l_quantity - 1)"),
    }
    return rounded(to_long(evaluate(base, kpis), [], list(kpis)), 4, "value")


@query
def kpi_median_stddev(spark, folder):
    kpis = {
        "median": Measure.median("l_extendedprice"), "median_large": Measure.median("l_extendedprice", "l_quantity > 25"),
        "stddev": Measure.stddev("l_extendedprice"), "min": Measure.min("l_quantity"), "max": Measure.max("l_quantity"),
    }
    lines = views.tables(spark, folder, "lineitem")["lineitem"]
    return rounded(evaluate(lines, kpis, {"dimension": F.col("l_returnflag")}), 4, "median", "median_large", "stddev")


@query
def kpi_median_total(spark, folder):
    lines = views.tables(spark, folder, "lineitem")["lineitem"]
    return rounded(evaluate(lines, {"median": Measure.median("l_extendedprice / l_quantity"), "rows": Measure.count()}), 4, "median")


STAR = [
    joins.Relationship("orders", "o_custkey", "customer", "c_custkey"),
    joins.Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
]


@query
def kpi_multi_table(spark, folder):
    t = views.tables(spark, folder, "orders", "customer", "nation")
    base = joins.join_tables(t, list(t), STAR, base="orders")
    kpis = {
        "orders": Measure.count("orders.o_orderkey"), "value": Measure.sum("orders.o_totalprice"),
        "customers": Measure.count_distinct("customer.c_custkey"),
        "per_customer": Measure.sum("orders.o_totalprice") / Measure.count_distinct("customer.c_custkey"),
    }
    return rounded(evaluate(base, kpis, {"dimension": F.col("nation.n_name")}), 4, "value", "per_customer")


@query
def kpi_multi_table_first(spark, folder):
    """The same with the alphabetically first table as base: customers without orders stay."""
    t = views.tables(spark, folder, "orders", "customer")
    base = joins.join_tables(t, list(t), STAR)
    kpis = {"rows": Measure.count(), "orders": Measure.count("orders.o_orderkey"),
            "balance": Measure.avg("customer.c_acctbal")}
    return rounded(evaluate(base, kpis, {"dimension": F.col("customer.c_mktsegment")}), 4, "balance")


# --- Slices ----------------------------------------------------------------


@query
def slice_filters(spark, folder):
    filters = [
        slices.Filter("order_ts", "between", ["1996-01-01", "1999-12-31"]),
        slices.Filter("segment", "not_in", ["BUILDING"]), slices.Filter("country", "contains", ["_1"]),
        slices.Filter("customer_id", "not_null"), slices.Filter("unit_price", "gt", [500]),
        slices.Filter("quantity", "ne", [7]),
    ]
    out = slices.slice_kpi(sales(spark, folder), measures("net_revenue")["net_revenue"], filters, "country", limit=5)
    return rounded(out, 2, "value")


@query
def slice_by_month(spark, folder):
    filters = [slices.Filter("status", "in", ["F", "O"]), slices.Filter("order_ts", "gte", ["1999-01-01"]),
               slices.Filter("order_ts", "lt", ["2001-01-01"])]
    out = slices.slice_kpi(sales(spark, folder), measures("average_order_value")["average_order_value"], filters,
                           "order_ts", "month", limit=36)
    return rounded(out.select(*text("dimension"), "value", "truncated"), 4, "value")


@query
def slice_scalar(spark, folder):
    filters = [slices.Filter("customer_id", "is_null"), slices.Filter("quantity", "lte", [10]),
               slices.Filter("status", "eq", ["P"])]
    return rounded(slices.slice_kpi(sales(spark, folder), measures("net_revenue")["net_revenue"], filters), 2, "value")


@query
def filter_options(spark, folder):
    return floating(slices.filter_options(sales(spark, folder), ["order_ts"], ["country", "segment", "status"]),
                    "rows", "rank", "distinct_values", "truncated")


@query
def relative_range(spark, folder):
    recent = slices.relative_range(views.sales(spark, folder), "order_ts", 6)
    return rounded(evaluate(recent, {"lines": Measure.count(), "units": Measure.sum("quantity")}, {"dimension": F.col("segment")}), 2, "units")


# --- Profiles --------------------------------------------------------------


def _once(spark, folder, name, build: Callable[[], DataFrame]) -> DataFrame:
    """A profile that several parts of one query start from."""
    if name not in _SETTLED:
        _SETTLED[name] = settle(build())
    return _SETTLED[name]


def sales_profile(spark, folder):
    return _once(spark, folder, "sales", lambda: profile.profile_columns(sales_rows(spark, folder), "sales"))


def messy(spark, folder):
    return views.view(spark, folder, views.MESSY)


def messy_profile(spark, folder):
    return _once(spark, folder, "messy", lambda: profile.profile_columns(messy(spark, folder), "orders"))


def messy_table(spark, folder):
    return _once(spark, folder, "messy table", lambda: profile.profile_tables(
        messy_profile(spark, folder), profile.duplicate_rows(messy(spark, folder), "orders")))


@query
def profile_columns(spark, folder):
    out = sales_profile(spark, folder).select(
        "table_name", "column_name", "logical_type", "semantic_hint", "row_count", "null_count", "null_pct",
        "distinct_count", "uniqueness_pct", "is_candidate_pk", "is_candidate_fk", "mean", "std", "min", "max",
        "negative_count", "min_date", "max_date", "granularity", F.array_join("warnings", "; ").alias("warnings"))
    return floating(rounded(out, 4, "mean", "std", "min", "max"), "negative_count")


@query
def profile_quantiles(spark, folder):
    out = sales_profile(spark, folder).where("kind = 'numeric'").select(
        "column_name", "value_count", "q25", "q50", "q75", "median", "outlier_count_iqr")
    return rounded(out, 4, "q25", "q50", "q75", "median")


@query
def profile_top_values(spark, folder):
    columns = sales_profile(spark, folder)
    return columns.select("column_name", F.posexplode("top_values")).select(
        "column_name", (F.col("pos") + 1).cast("bigint").alias("place"), F.col("col.value").alias("value"), F.col("col.count").alias("count"))


@query
def profile_samples(spark, folder):
    return sales_profile(spark, folder).where("kind = 'other' or column_name in ('product_id', 'order_ts')").select(
        "column_name", F.array_join("sample_values", "|").alias("sample_values"))


@query
def profile_decimal(spark, folder):
    """Decimal keys that are one number as doubles."""
    o, key = views.tables(spark, folder, "orders")["orders"], F.col("o_orderkey").cast("decimal(20,0)")
    big = (F.lit(9007199254740993).cast("decimal(20,0)") + key).cast("decimal(20,0)")
    fine = F.when(F.col("o_orderkey") % 3 == 0, F.expr("cast(cast(o_orderkey % 11 as decimal(5,0)) / 1000000000BD as decimal(38,30))"))
    table = o.select(big.alias("big_id"), (big - key % 7).cast("decimal(20,0)").alias("near"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("total"), fine.alias("fine"))
    return profile.profile_columns(table, "orders").select("column_name", "distinct_count", "null_count", "is_candidate_pk", F.col("sample_values")[0].alias("least"))


@query
def profile_long_text(spark, folder):
    """Counts, frequent and least values of whole documents, which are counted by fingerprint."""
    d = views.tables(spark, folder, "documents")["documents"]
    padded = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).when(F.col("doc_id") % 3 == 1, "")
    found = profile.profile_columns(d.select("text", "source", "lang", padded.alias("padded")), "documents")
    top = F.array_join(F.transform("top_values", lambda t: F.concat(t.value, F.lit(":"), t["count"].cast("string"))), "|")
    return found.select("column_name", (F.col("distinct_count") - (F.col("null_count") > 0).cast("int")).alias("distinct_values"), "whitespace_count", "empty_count",
                        F.md5("whitespace_example").alias("example"), F.md5(top).alias("top_values"), F.md5(F.array_join("sample_values", "|")).alias("sample_values"))


@query
def profile_table(spark, folder):
    out = messy_table(spark, folder)
    return out.select("table_name", "row_count", "column_count", "duplicate_row_count", "quality_score",
                      F.array_join("warnings", "; ").alias("warnings"))


@query
def profile_summary(spark, folder):
    summary = profile.profile_summary(messy_profile(spark, folder))
    share = profile.top_value_share(messy_profile(spark, folder))
    return rounded(share.join(summary, "table_name"), 4, "share_pct", "mean_null_pct")


@query
def date_granularity(spark, folder):
    t = views.tables(spark, folder, "orders", "events")
    found = profile.date_granularity(t["orders"], ["o_orderdate"])
    distinct = profile.date_granularity(t["orders"].select(F.col("o_orderdate").alias("order_days")).distinct(), ["order_days"])
    months = t["orders"].select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("order_months")).distinct()
    return (found.unionByName(distinct).unionByName(profile.date_granularity(months, ["order_months"]))
            .unionByName(profile.date_granularity(t["events"], ["ts"])))


@query
def pii_scan(spark, folder):
    t = views.tables(spark, folder, "customer", "documents", "conversations", "pages", "supplier")
    contacts = t["customer"].select(
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("contact"),
        F.concat(F.lit("+1 "), F.lpad(F.col("c_custkey").cast("string"), 10, "5")).alias("line"), "c_mktsegment",
        F.concat(F.lpad(F.hex("c_custkey"), 8, "0"), F.lit("-0000-4000-8000-000000000000")).alias("token"))
    found = together(*[lambda df=df, name=name: pii.detect_pii(df, name) for name, df in {**t, "contacts": contacts}.items()])
    return reduce(DataFrame.unionByName, found).drop("action")


@query
def pii_mask(spark, folder):
    c = views.tables(spark, folder, "customer")["customer"]
    mail = F.concat(F.lower("c_name"), F.lit("@example.com"))
    phone = F.concat(F.lit("+1 "), F.lpad(F.col("c_custkey").cast("string"), 10, "5"))
    return c.select("c_custkey", mask_value(mail, "email").alias("mail"), mask_value(phone, "phone").alias("phone"),
                    mask_value(F.col("c_name"), "name").alias("name"),
                    mask_value(F.substring("c_mktsegment", 1, 2), "name").alias("short"))


# --- Type inference --------------------------------------------------------


def text_orders(spark, folder):
    o = views.tables(spark, folder, "orders")["orders"]
    d = F.col("o_orderdate")
    odd = F.col("o_orderkey") % 50 == 3
    return o.select(
        F.date_format(d, "M/d/yyyy H:mm").alias("us_time"), F.date_format(d, "dd/MM/yyyy").alias("eu_date"),
        F.date_format(F.make_date(F.year(d), F.month(d), F.day(d) % 12 + 1), "MM/dd/yyyy").alias("unsure_date"),
        F.date_format(d, "yyyy-MM-dd HH:mm:ss").alias("iso_time"),
        F.when(odd, "2001-13-45").otherwise(F.date_format(d, "yyyy-MM-dd")).alias("dirty_date"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy/MM/dd")).alias("mixed_date"),
        F.format_number("o_totalprice", 2).alias("total_text"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("plain_total"),
        F.when(odd, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("dirty_total"),
        F.lpad((F.col("o_orderkey") % 100000).cast("string"), 6, "0").alias("padded"), F.col("o_custkey").cast("string").alias("account_no"),
        "o_orderpriority", "o_totalprice")


@query
def infer_decisions(spark, folder):
    _, found = infer.infer_types(text_orders(spark, folder), "orders")
    frame = infer.decisions_frame(spark, found)
    return frame.select("column_name", "action", "format", "parse_rate", "sample_size",
                        F.size("warnings").cast("bigint").alias("warnings"),
                        F.exists("warnings", lambda w: w.contains("Ambiguous date order")).alias("unsure"))


@query
def infer_format_rates(spark, folder):
    columns = ["us_time", "eu_date", "unsure_date", "iso_time", "mixed_date"]
    rates = infer.format_rates(counts.count_texts(text_orders(spark, folder), columns).rows, columns)
    rows = [(c, f, float(r)) for c, found in rates.items() for f, r in found.items() if r]
    return rounded(spark.createDataFrame(rows, "column_name string, format string, parse_rate double"), 6, "parse_rate")


@query
def infer_apply(spark, folder):
    typed, _ = infer.infer_types(text_orders(spark, folder), "orders")
    dates = ["us_time", "eu_date", "unsure_date", "iso_time", "dirty_date"]
    return typed.agg(
        *[F.min(c).cast("string").alias(f"min_{c}") for c in dates], *[F.max(c).cast("string").alias(f"max_{c}") for c in dates],
        *[F.count(c).alias(f"n_{c}") for c in dates], F.round(F.sum("total_text"), 2).alias("total_text"),
        F.round(F.sum("plain_total"), 2).alias("plain_total"), F.count("dirty_total").alias("dirty_total"),
        F.max("padded").alias("padded"))


# --- Quality and cleanup ---------------------------------------------------


def messy_issues(spark, folder):
    return quality.quality_issues(messy_profile(spark, folder), messy_table(spark, folder))


@query
def quality_issues(spark, folder):
    return messy_issues(spark, folder).select("table_name", "column_name", "issue_type", "severity", "rows_affected",
                                              "detection_method")


@query
def quality_scorecard(spark, folder):
    return quality.scorecard(messy_table(spark, folder), messy_issues(spark, folder))


@query
def quality_run_score(spark, folder):
    return quality.run_quality(quality.scorecard(messy_table(spark, folder), messy_issues(spark, folder)))


@query
def quality_decision_issues(spark, folder):
    _, found = infer.infer_types(text_orders(spark, folder), "orders")
    issues = quality.decision_issues(infer.decisions_frame(spark, found))
    return issues.select("column_name", "issue_type", "severity", "rows_affected")


def _cleaned(spark, folder):
    return clean.execute_plan({"orders": messy(spark, folder)}, clean.collect_plan(messy_issues(spark, folder)))


@query
def clean_apply(spark, folder):
    cleaned, _ = _cleaned(spark, folder)
    return floating(cleaned["orders"], "customer_id").select("order_id", "customer_id", "status", "priority", "amount", "units", *text("order_ts"))


@query
def clean_log(spark, folder):
    _, log = _cleaned(spark, folder)
    return log.select("step", "operation", "column_name", "rows_affected", "before_example", "after_example")


@query
def clean_explicit_steps(spark, folder):
    """Cleanups that are only run when asked for."""
    source = text_orders(spark, folder).select("o_orderpriority", "plain_total", "dirty_total", "us_time", F.lit(None).cast("string").alias("gone"))
    source = source.unionByName(source.where("us_time like '1/1/%'").select(*[F.lit(None).cast("string").alias(c) for c in source.columns]))
    steps = [
        clean.Step("drop_all_null_rows", "t"), clean.Step("normalize_case", "t", "o_orderpriority"),
        clean.Step("cast_numeric", "t", "plain_total"), clean.Step("cast_numeric", "t", "dirty_total"),
        clean.Step("cast_datetime", "t", "us_time", format="%m/%d/%Y %H:%M"),
    ]
    cleaned, log = clean.execute_plan({"t": source}, steps)
    groups = cleaned["t"].groupBy(F.col("o_orderpriority").alias("item")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("dirty_total"), 2).alias("total"), F.max("us_time").cast("string").alias("last"))
    logged = log.select(F.concat_ws(" ", "operation", "column_name").alias("item"), F.col("rows_affected").alias("rows"))
    return groups.unionByName(logged, allowMissingColumns=True)


# --- Joins -----------------------------------------------------------------


def join_views(spark, folder):
    sql = {"customers": views.DIM_CUSTOMER, "orders": views.FACT_ORDERS, "lines": views.FACT_LINES, "nations": views.DIM_NATION}
    return {name: views.view(spark, folder, text) for name, text in sql.items()}


def _joins(spark, folder):
    return _once(spark, folder, "joins", lambda: joins.discover_joins(join_views(spark, folder)))


@query
def join_candidates(spark, folder):
    return _joins(spark, folder).select(
        "source_table", "source_column", "target_table", "target_column", "overlap_ratio", "source_uniqueness",
        "target_uniqueness", "cardinality", "confidence", "validated", "shared_values")


@query
def orphan_values(spark, folder):
    return quality.referential_issues(_joins(spark, folder)).select(
        "table_name", "column_name", "severity", "rows_affected", F.col("evidence")["target"].alias("target"))


# --- Roles -----------------------------------------------------------------


@query
def role_scores(spark, folder):
    return roles.score_roles(sales_profile(spark, folder)).select("role", "column_name", "confidence")


@query
def role_bindings(spark, folder):
    return roles.assign_roles(roles.score_roles(sales_profile(spark, folder))).select("role", "table_name", "column_name", "confidence")


@query
def role_bindings_overridden(spark, folder):
    """A caller's choice replaces what was found for its role, and notes follow it."""
    columns = sales_profile(spark, folder)
    found = roles.assign_roles(roles.score_roles(columns))
    bound = roles.with_overrides(found, columns, {"event_date": "sales.order_ts", "category": "sales.status"})
    notes = roles.unbound_notes(bound).where("role in ('event_date', 'category')")
    return bound.select("role", "table_name", "column_name", "confidence").unionByName(
        notes.select("role", F.lit("note").alias("table_name"), F.col("note").alias("column_name"), F.lit(0.0).alias("confidence")))


@query
def role_notes(spark, folder):
    return roles.unbound_notes(roles.assign_roles(roles.score_roles(sales_profile(spark, folder))))


@query
def returns_convention(spark, folder):
    return roles.returns_convention(views.sales(spark, folder), "quantity", "order_id")


@query
def chart_dimensions(spark, folder):
    return roles.chart_dimensions(sales_profile(spark, folder)).drop("position")


@query
def dimensions_left_out(spark, folder):
    """Labels of 200 and of 201 values: the second is no axis, and is told with the reason."""
    o, label = views.tables(spark, folder, "orders")["orders"], lambda head, c, n: F.concat(F.lit(head), (F.col(c) % n).cast("string"))
    table = o.select(label("c", "o_orderkey", 201).alias("basket"), label("d", "o_orderkey", 200).alias("shelf"), label("e", "o_custkey", 3).alias("customer_city"), F.col("o_orderdate").alias("order_day"))
    columns = settle(profile.profile_columns(table, "orders"))
    both = roles.chart_dimensions(columns).unionByName(roles.left_out_dimensions(columns), allowMissingColumns=True)
    return both.select("column_name", "reason", "confidence")


@query
def breakdown_fall_through(spark, folder):
    """Breakdowns whose first dimension has no value on any row: the next one is taken, per set of tables."""
    tables = {"sales": views.sales(spark, folder).withColumn("nothing", F.lit(None).cast("string")), "events": views.tables(spark, folder, "events")["events"]}
    specs = [s for s in catalogue() if s.slug in ("net_revenue", "order_count")] + catalog.fallback([("events", "value", "AVG", None)], [])
    bound = roles.Binding({}, "C", True, (("sales.nothing", "categorical"), ("sales.country", "geo"), ("events.event_type", "categorical")))
    parts = suite.compute_kpis(tables, specs, bound, RUN, segments=7).breakdown
    return whole(rounded(parts.select("kpi", "dimension_name", "dimension", "value", "rank"), 2, "value"), "rank")


@query
def spec_errors(spark, folder):
    """Measures that name columns in any case, and such that name none, two or no table of theirs."""
    t = views.tables(spark, folder, "orders", "customer")
    customers = t["customer"].withColumnRenamed("c_name", "o_orderstatus")
    both = joins.join_tables({"orders": t["orders"], "customer": customers}, ["orders", "customer"], STAR[:1], base="orders")
    asked = {
        "any_case": Measure.count("ORDERS.O_OrderKey"), "qualified": Measure.count_distinct("customer.c_custkey"), "unknown_column": Measure.sum("o_nothing"),
        "unknown_table": Measure.sum("suppliers.o_totalprice"), "ambiguous": Measure.count("o_orderstatus"), "no_aggregate": Measure("num", 3),
    }
    errors = spec_problems(both, asked)
    good = {k: m for k, m in asked.items() if k not in errors}
    found = to_long(evaluate(both, good), [], list(good)).withColumn("status", F.lit("computed"))
    bad = spark.createDataFrame([(k,) for k in errors], "kpi string").withColumns({"value": F.lit(None).cast("double"), "status": F.lit("invalid_formula")})
    return found.unionByName(bad).select("kpi", "status", F.col("value").cast("bigint").alias("value"))


@query
def model_items(spark, folder):
    columns = sales_profile(spark, folder)
    dims = roles.model_dimensions(columns).select(F.lit("dimension").alias("item"), "column_name", F.col("dim_type").alias("kind"))
    return dims.unionByName(roles.model_measures(columns).select(F.lit("measure").alias("item"), "column_name", F.col("aggregation").alias("kind")))


@query
def domain_inference(spark, folder):
    """Domains of the conversations, each turn read as an objective."""
    turns = views.tables(spark, folder, "conversations")["conversations"]
    found = roles.infer_domain(turns, F.col("text"), F.array(F.lit("role"), F.col("role")))
    return found.select("conv_id", "turn", "domain", "score", F.array_join("matched_terms", ",").alias("matched_terms"), "confident")


# --- Statistics ------------------------------------------------------------


def country_points(spark, folder):
    line = series.kpi_series(sales(spark, folder), measures("net_revenue", "units_sold"), F.col("sales.order_ts"),
                             "quarter", by={"country": F.col("sales.country")})
    return series.complete_points(line)


COUNTRY = ("country", "kpi")


@query
def zscore_anomalies(spark, folder):
    out = whole(stats.zscore_anomalies(country_points(spark, folder), COUNTRY, limit=2.0), "index")
    return rounded(out.select(*COUNTRY, *text("period"), "index", "value", "zscore", "method"), 4, "value", "zscore")


@query
def iqr_outliers(spark, folder):
    out = whole(stats.iqr_outliers(country_points(spark, folder), COUNTRY), "index")
    return rounded(out.select(*COUNTRY, *text("period"), "index", "value", "method"), 4, "value")


@query
def linear_trend(spark, folder):
    return rounded(stats.linear_trend(country_points(spark, folder), COUNTRY), 4, "slope", "intercept", "r2")


@query
def peak_trough(spark, folder):
    out = stats.peak_trough(country_points(spark, folder), COUNTRY)
    return rounded(out.select(*COUNTRY, *text("peak_period", "trough_period"), "peak_value", "trough_value", "periods", "amplitude_pct"),
                   4, "peak_value", "trough_value", "amplitude_pct")


@query
def pareto(spark, folder):
    top = stats.pareto(views.sales(spark, folder), "product_id", "quantity")
    return whole(rounded(top, 6, "value", "cumulative_share"), "cutoff_count", "groups", "rank")


@query
def correlation(spark, folder):
    return rounded(stats.correlation_pairs(views.sales(spark, folder)), 6, "correlation").select("left", "right", "correlation", "rows")


@query
def row_concentration(spark, folder):
    return rounded(stats.row_concentration(views.sales(spark, folder), "country"), 6, "share")


# --- Findings and audit ----------------------------------------------------


def _results(spark, folder) -> dict[str, DataFrame]:
    """KPI artefacts of one run over the sales view, shared by the parts of one query."""
    if "results" not in _SETTLED:
        found = suite.compute_kpis({"sales": sales_rows(spark, folder)}, catalogue(), BINDING, RUN)
        _SETTLED["results"] = {"kpis": settle(found.values), "series": found.series, "breakdown": found.breakdown}
    return _SETTLED["results"]


def _stats(spark, folder):
    points = series.complete_points(_results(spark, folder)["series"])
    keys = ("run_id", "kpi")
    return stats.linear_trend(points, keys), stats.anomalies(points, keys), stats.peak_trough(points, keys)


SHOWN = ("rule", "kpi", "title", "category", "severity", "confidence", "recommendation_basis")


def _findings(spark, folder) -> DataFrame:
    run, table = F.lit(RUN).alias("run_id"), sales_rows(spark, folder)
    r, columns, top, pairs = together(
        lambda: _results(spark, folder), lambda: sales_profile(spark, folder), lambda: stats.pareto(table, "country", "quantity").where("rank = 1"),
        lambda: kept(stats.correlation_pairs(table)))
    trends, odd, seasons = _stats(spark, folder)
    kpis = r["kpis"]
    top = top.select(run, F.lit("country").alias("dimension_name"), F.lit("quantity").alias("measure_name"), "cutoff_count", "groups")
    pairs = pairs.select(run, F.lit("sales").alias("table_name"), "left", "right", "correlation")
    bound = roles.assign_roles(roles.score_roles(columns))
    notes = roles.unbound_notes(bound).select(run, F.col("role").alias("place"), "note")
    return insights.all_findings(
        insights.change_findings(kpis, trends), insights.level_findings(kpis), insights.trend_findings(kpis, trends),
        insights.anomaly_findings(kpis, odd, trends), insights.return_findings(kpis),
        insights.segment_findings(kpis, r["breakdown"]), insights.season_findings(kpis, seasons),
        insights.pareto_findings(top), insights.correlation_findings(pairs), insights.caveat_findings(notes))


@query
def insights_change(spark, folder):
    trends, _, _ = _stats(spark, folder)
    out = insights.change_findings(_results(spark, folder)["kpis"], trends)
    return out.select(*SHOWN, "comparison", "period")


@query
def insights_segment(spark, folder):
    r = _results(spark, folder)
    by_status = grouped(sales_rows(spark, folder).alias("sales"), measures("net_revenue", "units_sold", "returned_value", "average_unit_price"),
                        F.when(F.col("sales.segment").isin("BUILDING", "FURNITURE"), F.col("sales.segment")).otherwise("OTHER"), limit=15, totals=True)
    return insights.segment_findings(r["kpis"], by_status.withColumn("run_id", F.lit(RUN))).select(*SHOWN, "comparison")


@query
def insights_trend_season(spark, folder):
    trends, _, seasons = _stats(spark, folder)
    kpis = _results(spark, folder)["kpis"]
    both = insights.trend_findings(kpis, trends).unionByName(insights.season_findings(kpis, seasons))
    return rounded(both.select("rule", "kpi", "title", "category", "severity", "confidence", "recommendation_basis"), 6, "confidence")


@query
def insights_returns(spark, folder):
    return insights.return_findings(_results(spark, folder)["kpis"]).select(*SHOWN)


@query
def insights_ranked(spark, folder):
    ranked = insights.rank(insights.score(_findings(spark, folder)))
    return whole(ranked, "rank").select("rank", "rule", "kpi", "title", "score", "recommendation", "recommendation_basis")


@query
def insights_advice(spark, folder):
    """Titles and advice of all findings in full."""
    return _findings(spark, folder).select("rule", "kpi", "title", "category", "severity", "recommendation_basis", "recommendation")


@query
def insights_level(spark, folder):
    """Without a date there is no change to tell: the plain values in words."""
    undated = roles.Binding({k: v for k, v in BINDING.roles.items() if k != "event_date"}, BINDING.cancel_prefix, True)
    found = suite.compute_kpis({"sales": sales_rows(spark, folder)}, catalogue(), undated, RUN)
    return insights.level_findings(found.values).select("rule", "kpi", "title", "description")


@query
def ranking_by_run(spark, folder):
    """Orders as findings of forty runs: the greedy choice under all three caps."""
    o = views.tables(spark, folder, "orders")["orders"]
    key, text = F.col("o_orderkey"), lambda head, n: F.concat(F.lit(head), (F.col("o_orderkey") % n).cast("string"))
    scored = o.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("run_id"), key.alias("position"), F.lit(None).cast("string").alias("kpi"),
        F.when(key % 2 == 0, text("Finding ", 97)).otherwise(text("FINDING ", 97)).alias("title"), text("m", 11).alias("metric"),
        F.when(key % 5 != 0, text("rule ", 6)).alias("recommendation_basis"), F.round(F.col("o_totalprice") / 50000).alias("score"))
    return whole(insights.rank(scored).select("run_id", "rank", "position"), "rank")


@query
def insight_scores(spark, folder):
    return rounded(insights.score(insights.change_findings(_results(spark, folder)["kpis"], _stats(spark, folder)[0])).select(
        "kpi", "score"), 4, "score")


@query
def insight_counts(spark, folder):
    trends, _, seasons = _stats(spark, folder)
    kpis = _results(spark, folder)["kpis"]
    found = insights.all_findings(insights.change_findings(kpis, trends), insights.trend_findings(kpis, trends),
                                  insights.return_findings(kpis), insights.season_findings(kpis, seasons))
    return insights.finding_counts(found)


@query
def number_wording(spark, folder):
    lines = views.tables(spark, folder, "lineitem")["lineitem"]
    spread = F.col("l_extendedprice") / F.pow(F.lit(10.0), (F.col("l_orderkey") % 7).cast("double"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", humanize(spread).alias("wording"))


@query
def claim_grounding(spark, folder):
    """Claims that a KPI's value in one country is its value overall, a fifth of a percent off."""
    r = _results(spark, folder)
    kpis = r["kpis"].where(F.col("kpi").isin("average_order_value", "order_return_rate", "average_unit_price", "net_revenue"))
    claims = r["breakdown"].where(F.col("kpi").isin("average_order_value", "order_return_rate", "average_unit_price", "net_revenue")).join(
        kpis.select("kpi", "name"), "kpi").select(
        "run_id", F.concat(F.lit(" "), F.upper("name")).alias("metric"), (F.col("value") * 1.002).alias("value"), "dimension")
    return insights.ground_claims(claims, kpis).select("metric", "dimension", "grounded")


@query
def audit_events(spark, folder):
    return audit.kpi_events(_results(spark, folder)["kpis"])


@query
def run_verdict(spark, folder):
    scores = quality.scorecard(messy_table(spark, folder), messy_issues(spark, folder))
    return audit.verdict(_results(spark, folder)["kpis"], quality.run_quality(scores).select(F.lit(RUN).alias("run_id"), "overall_score"))


@query
def kpi_explanations(spark, folder):
    log = _cleaned(spark, folder)[1].withColumn("run_id", F.lit(RUN))
    notes = spark.createDataFrame([], "run_id string, place string, note string")
    return audit.explanations(_results(spark, folder)["kpis"], log, notes).select(
        "kpi", "what_happened", "data_used", "quality_limitations", "transformations")


@query
def kpi_lineage(spark, folder):
    kpis = _results(spark, folder)["kpis"]
    nodes = audit.lineage_nodes(kpis).select("kpi", F.lit("node").alias("item"), F.col("id").alias("a"), F.col("type").alias("b"), "label")
    return nodes.unionByName(audit.lineage_edges(kpis).select("kpi", F.lit("edge").alias("item"), F.col("source").alias("a"), F.col("target").alias("b"), "label"))


@query
def evaluation(spark, folder):
    sales_rows(spark, folder)  # read by two of the three
    r, (_, found), columns = together(
        lambda: _results(spark, folder), lambda: infer.infer_types(text_orders(spark, folder), "orders"), lambda: sales_profile(spark, folder))
    kpis = r["kpis"]
    returned = insights.return_findings(kpis)
    return reduce(DataFrame.unionByName, [
        audit.formula_validity(kpis), audit.groundedness(returned), audit.hallucination_rate(returned),
        audit.binding_rate(kpis), audit.type_resolution(infer.decisions_frame(spark, found)),
        audit.baseline_lift(kpis, columns)])


@query
def join_candidates_decimal(spark, folder):
    """Ids beyond 2^53: no double tells neighbours apart, decimals do."""
    o = views.tables(spark, folder, "orders")["orders"]
    key = lambda more: (F.col("o_orderkey").cast("decimal(20,0)") * 2 + F.lit(f"{2**53 * 8 + more}").cast("decimal(20,0)")).cast("decimal(20,0)").alias("order_id")
    tables = {"a": o.select(key(0)), "b": o.select(key(1)), "c": o.where("o_orderkey % 2 = 0").select(key(0))}
    return joins.discover_joins(tables).select("source_table", "target_table", "overlap_ratio", "shared_values", "validated")


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


@query
def csv_read(spark, folder):
    """Orders written as CSV with line breaks in quotes and read back, with the number of malformed records."""
    o = views.tables(spark, folder, "orders")["orders"]
    path = _scratch(spark) + ".csv"
    note = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('"; x'))
    o.select("o_orderkey", note.alias("note")).write.csv(path, header=True, sep=";", quoteAll=True, escape='"')
    bad = readers.malformed(spark, path).first()["malformed_count"]
    return readers.read_table(spark, path).withColumn("malformed_count", F.lit(bad).cast("bigint"))


@query
def csv_lines(spark, folder):
    """Orders as CSV without line breaks in fields: read in parts, the shape told by the quotes of its lines."""
    o = views.tables(spark, folder, "orders")["orders"]
    path = _scratch(spark) + ".csv"
    o.select("o_orderkey", "o_orderstatus", F.concat(F.lit('5" x; '), "o_orderpriority").alias("note")).write.csv(path, header=True, sep=";", escape='"')
    shape = readers.csv_shape(spark, path)
    told = f"{'semicolon' if shape.delimiter == ';' else shape.delimiter}, {'records over lines' if shape.multi_line else 'one line a record'}"
    return readers.read_table(spark, path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys")).withColumn("shape", F.lit(told))


@query
def typed_load(spark, folder):
    """A CSV read with its types inferred."""
    o = views.tables(spark, folder, "orders")["orders"]
    path = _scratch(spark) + ".csv"
    o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), F.col("o_orderpriority").alias("priority"),
             F.col("o_totalprice").cast("decimal(18,2)").alias("total")).write.csv(path, header=True)
    typed, decisions = readers.read_typed(spark, path, "orders")
    told = ",".join(sorted(f"{d.column_name}={d.action}" for d in decisions))
    return typed.agg(F.min("ordered").cast("date").cast("string").alias("first_day"), F.max("ordered").cast("date").cast("string").alias("last_day"),
                     F.round(F.sum("total"), 2).alias("total"), F.count(F.lit(1)).alias("rows")).withColumn("decisions", F.lit(told))


@query
def row_limit(spark, folder):
    """How many rows a limited reading and a sample have, next to all."""
    lines = f"{folder}/lineitem.parquet"
    counts = [readers.read_table(spark, lines).agg(F.count(F.lit(1)).alias("rows")),
              readers.read_table(spark, lines, n_rows=100).agg(F.count(F.lit(1)).alias("limited")),
              readers.sample(readers.read_table(spark, lines)).agg(F.count(F.lit(1)).alias("sampled")),
              readers.metadata(readers.read_table(spark, lines), "lineitem").select(F.col("row_count").alias("whole"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts).agg(*[F.max(c).alias(c) for c in ("rows", "limited", "sampled", "whole")])


@query
def layer_round_trip(spark, folder):
    """A written Parquet layer registered as views, read by SQL."""
    path = _scratch(spark)
    writers.write_layer(views.tables(spark, folder, "customer", "nation"), path)
    c, n = writers.register_layer(spark, path, ["customer", "nation"])
    return spark.sql(f"SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name")


@query
def kpi_csv_sink(spark, folder):
    """The KPI catalogue as CSV, read back."""
    path = _scratch(spark) + ".csv"
    writers.write_catalogue_csv(_results(spark, folder)["kpis"], path)
    back = readers.read_table(spark, path)
    return rounded(back.select("name", F.col("value").cast("double").alias("value"), "unit", "status"), 2, "value")


@query
def report_json_sink(spark, folder):
    """A report section as JSON lines, read back."""
    path = _scratch(spark)
    writers.write_report({"kpis": _results(spark, folder)["kpis"].select("kpi", "value", "status")}, path)
    return rounded(spark.read.schema("kpi string, value double, status string").json(f"{path}/kpis"), 2, "value")


@query
def dataset_metadata(spark, folder):


    found = [metadata(df, name) for name, df in views.tables(spark, folder, *views.TABLES).items()]
    return reduce(DataFrame.unionByName, found).select("name", "source_type", "row_count", F.col("column_count").cast("bigint").alias("column_count"))


@query
def full_run(spark, folder):
    """The whole suite over the sales view; KPI values with their last change."""
    found = suite.run_suite({"sales": sales_rows(spark, folder)}, "retail", "retail",
                            overrides={"event_date": "sales.order_ts"}, run_id=RUN)
    return rounded(rounded(found["kpi_values"].select("kpi", "name", "status", "value", "change_pct"), 2, "value"), 4, "change_pct")
