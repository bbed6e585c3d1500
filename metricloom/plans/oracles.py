"""The registered queries as SQL for an independent engine (DuckDB dialect), for checking."""

from __future__ import annotations

from metricloom import fixed_values as fixed
from metricloom.plans import views
from metricloom.plans.queries import catalogue

SALES = f"WITH sales AS ({views.duck(views.SALES)})"
MESSY = f"WITH orders_m AS ({views.duck(views.MESSY)})"
ORACLES: dict[str, str] = {}

KEPT, CANCELLED = "order_id NOT LIKE 'C%'", "order_id LIKE 'C%'"
REVENUE = "sum(quantity * unit_price)"
GROSS = f"sum(CASE WHEN {KEPT} THEN quantity * unit_price END)"
ORDERS = f"count(DISTINCT CASE WHEN {KEPT} THEN order_id END)"
GONE = f"count(DISTINCT CASE WHEN {CANCELLED} THEN order_id END)"
UNITS = "sum(CASE WHEN quantity > 0 THEN quantity END)"
KPI = {
    "net_revenue": REVENUE,
    "gross_revenue": GROSS,
    "returned_value": "sum(CASE WHEN quantity < 0 THEN quantity * unit_price END)",
    "order_count": ORDERS,
    "cancelled_orders": GONE,
    "unique_customers": "count(DISTINCT customer_id)",
    "average_order_value": f"{GROSS} / nullif({ORDERS}, 0)",
    "revenue_per_customer": f"{REVENUE} / nullif(count(DISTINCT customer_id), 0)",
    "units_sold": UNITS,
    "units_per_order": f"{UNITS} / nullif(count(DISTINCT order_id), 0)",
    "order_return_rate": f"{GONE} / nullif(count(DISTINCT order_id), 0) * 100",
    "active_products": "count(DISTINCT product_id)",
    "average_unit_price": "avg(unit_price)",
    "gross_margin": f"{REVENUE} - sum(quantity * cost)",
    "transaction_lines": "count(*)",
    "freight_cost": "sum(freight)",
    "discount_given": "sum(discount)",
}
ROW = {  # name, unit, additivity, priority, higher is better
    "net_revenue": ("Net Revenue", "currency", "additive", 1, True),
    "gross_revenue": ("Gross Revenue", "currency", "additive", 2, True),
    "returned_value": ("Returned Value", "currency", "additive", 6, False),
    "order_count": ("Orders", "count", "semi_additive", 3, True),
    "cancelled_orders": ("Cancelled Orders", "count", "semi_additive", 6, False),
    "unique_customers": ("Unique Customers", "count", "semi_additive", 4, True),
    "average_order_value": ("Average Order Value", "currency", "non_additive", 5, True),
    "revenue_per_customer": ("Revenue per Customer", "currency", "non_additive", 7, True),
    "units_sold": ("Units Sold", "units", "additive", 8, True),
    "units_per_order": ("Units per Order", "units", "non_additive", 9, True),
    "order_return_rate": ("Order Return Rate", "percent", "non_additive", 10, False),
    "active_products": ("Active Products", "count", "semi_additive", 11, True),
    "average_unit_price": ("Average Unit Price", "currency", "non_additive", 12, True),
    "gross_margin": ("Gross Margin", "currency", "additive", 13, True),
    "transaction_lines": ("Transaction Lines", "count", "additive", 40, True),
    "freight_cost": ("Freight Cost", "currency", "additive", 14, False),
    "discount_given": ("Discount Given", "currency", "additive", 15, False),
}


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def long(measures: dict[str, str], source: str, keys: str = "", digits: int | None = 2) -> str:
    """One row per measure and group of ``keys`` (``expression AS name, ...``)."""
    value = "CAST({} AS DOUBLE)" if digits is None else f"round(CAST({{}} AS DOUBLE), {digits}) + 0.0"
    lead = f"{keys}, " if keys else ""
    group = " GROUP BY ALL" if keys else ""
    return union(f"SELECT {lead}'{k}' AS kpi, {value.format(m)} AS value FROM {source}{group}" for k, m in measures.items())


def pick(*names: str) -> dict[str, str]:
    return {n: KPI[n] for n in names}


ORACLES["kpi_scalar_suite"] = f"{SALES} {long(KPI, 'sales')}"
ORACLES["kpi_freight_discount"] = f"{SALES} {long(pick('freight_cost', 'discount_given'), 'sales')}"
_rows = ", ".join(f"('{k}', '{n}', '{u}', '{a}', {p}, {b})" for k, (n, u, a, p, b) in ROW.items())
ORACLES["kpi_catalogue"] = f"""{SALES}, v AS ({long(KPI, 'sales')}),
c(kpi, name, unit, additivity, priority, higher_is_better) AS (VALUES {_rows})
SELECT c.*, v.value FROM c JOIN v USING (kpi)"""
ORACLES["kpi_fallback"] = long(
    {"avg_value": "avg(value)", "sum_user_id": "sum(user_id)", "distinct_event_id": "count(DISTINCT event_id)",
     "distinct_event_type": "count(DISTINCT event_type)"}, "events", digits=4)
ORACLES["kpi_by_segment"] = f"""{SALES}, v AS ({long(pick("net_revenue", "order_count", "average_order_value", "order_return_rate"),
    "sales WHERE country IS NOT NULL", "country AS dimension", None)}),
r AS (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY value DESC NULLS LAST, dimension) AS rank FROM v)
SELECT kpi, dimension, round(value, 2) AS value, rank FROM r WHERE rank <= 15"""

STEP = {"hour": ("1 HOUR", "1 MINUTE"), "day": ("1 DAY", "1 HOUR"), "week": ("7 DAY", "1 DAY"), "month": ("1 MONTH", "1 DAY"),
        "quarter": ("3 MONTH", "1 DAY"), "year": ("12 MONTH", "1 DAY")}


def line(measures: dict[str, str], source: str, ts: str, grain: str, keys: str = "") -> str:
    """Series with partial flags, periods still timestamps."""
    step, slack = STEP[grain]
    lead = f"{keys}, " if keys else ""
    points = long(measures, source, f"{lead}CAST(date_trunc('{grain}', {ts}) AS TIMESTAMP) AS period", None)
    return f"""SELECT *, period + INTERVAL {step} - INTERVAL {slack} > (SELECT max({ts}) FROM {source}) AS partial
    FROM ({points})"""


AUTO = """CASE WHEN d <= 2 THEN 'hour' WHEN d <= 62 THEN 'day' WHEN d <= 730 THEN 'month' WHEN d <= 2920 THEN 'quarter' ELSE 'year' END"""
SHOW = "CAST(period AS VARCHAR) AS period"


def shown(series: str, digits: int = 2) -> str:
    return f"SELECT kpi, {SHOW}, round(value, {digits}) AS value, partial FROM ({series})"


ORACLES["kpi_series_quarter"] = f"""{SALES} {shown(line(pick("net_revenue", "returned_value", "order_count",
    "average_order_value", "unique_customers"), "sales", "order_ts", "quarter"))}"""
EVENTS = {"events": "count(*)", "users": "count(DISTINCT user_id)", "value": "sum(value)"}
for _grain, _name in (("day", "daily"), ("hour", "hourly"), ("week", "weekly")):
    ORACLES[f"kpi_series_{_name}"] = shown(line(EVENTS, "events", "ts", _grain), 4)


def changes(series: str, keys: str = "kpi") -> str:
    return f"""SELECT {keys}, max(value) FILTER (n = 1) AS current_value, max(value) FILTER (n = 2) AS previous_value,
    max(period) FILTER (n = 1) AS comparison_period, max(period) FILTER (n = 2) AS baseline_period,
    (SELECT max(z.period) FROM series z WHERE z.kpi = w.kpi HAVING bool_or(z.partial AND z.period = (SELECT max(y.period) FROM series y WHERE y.kpi = w.kpi))) AS excluded_period
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY period DESC) AS n FROM series WHERE NOT partial AND value IS NOT NULL) w
    GROUP BY {keys}"""


ORACLES["kpi_period_change"] = f"""{SALES}, series AS ({line(pick("net_revenue", "order_count", "units_sold"), "sales", "order_ts", "quarter")}),
c AS ({changes("series")})
SELECT kpi, round(current_value, 2) AS current_value, round(previous_value, 2) AS previous_value,
round((current_value - previous_value) / nullif(previous_value, 0), 6) AS change_pct,
CAST(comparison_period AS VARCHAR) AS comparison_period, CAST(baseline_period AS VARCHAR) AS baseline_period,
CAST(excluded_period AS VARCHAR) AS excluded_period FROM c"""

ORACLES["kpi_predicates"] = long({
    "returned": "sum(l_quantity) FILTER (l_returnflag = 'R')",
    "not_returned": "sum(l_quantity) FILTER (l_returnflag <> 'R')",
    "cheap_or_small": "count(*) FILTER ((l_extendedprice < 1000 OR p_size <= 3) AND l_discount >= 0.05)",
    "rings": "count(DISTINCT l_partkey) FILTER (p_name LIKE '%ring')",
    "no_rings": "count(DISTINCT l_partkey) FILTER (p_name NOT LIKE '%r_ng')",
    "some_brands": "avg(l_extendedprice) FILTER (p_brand IN ('Brand#1', 'Brand#12', 'Brand#21'))",
    "other_brands": "avg(l_extendedprice) FILTER (p_brand NOT IN ('Brand#1', 'Brand#12'))",
    "known": "count(l_tax) FILTER (p_type IS NOT NULL)",
    "unknown": "count(l_tax) FILTER (p_type IS NULL)",
    "nothing": "sum(l_quantity) FILTER (l_quantity > 1000) / nullif(count(*) FILTER (l_quantity > 1000), 0)",
    "spread": "max(l_extendedprice) - min(l_extendedprice)",
    "negated": "-sum(l_tax * (l_quantity - 1))",
}, "lineitem LEFT JOIN part ON l_partkey = p_partkey", digits=4)
ORACLES["kpi_median_stddev"] = """SELECT l_returnflag AS dimension, round(median(l_extendedprice), 4) AS median,
round(median(l_extendedprice) FILTER (l_quantity > 25), 4) AS median_large, round(stddev_samp(l_extendedprice), 4) AS stddev,
CAST(min(l_quantity) AS DOUBLE) AS min, CAST(max(l_quantity) AS DOUBLE) AS max FROM lineitem GROUP BY 1"""
ORACLES["kpi_median_total"] = """SELECT round(median(l_extendedprice / l_quantity), 4) AS median,
CAST(count(*) AS DOUBLE) AS rows FROM lineitem"""
ORACLES["kpi_multi_table"] = """SELECT n_name AS dimension, CAST(count(o_orderkey) AS DOUBLE) AS orders,
round(sum(o_totalprice), 4) AS value, CAST(count(DISTINCT c_custkey) AS DOUBLE) AS customers,
round(sum(o_totalprice) / nullif(count(DISTINCT c_custkey), 0), 4) AS per_customer
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IS NOT NULL GROUP BY 1"""
ORACLES["kpi_multi_table_first"] = """SELECT c_mktsegment AS dimension, CAST(count(*) AS DOUBLE) AS rows,
CAST(count(o_orderkey) AS DOUBLE) AS orders, round(avg(c_acctbal), 4) AS balance
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1"""

# --- Slices
_where = """order_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND segment NOT IN ('BUILDING')
AND country LIKE '%_1%' AND customer_id IS NOT NULL AND unit_price > 500 AND quantity <> 7"""
ORACLES["slice_filters"] = f"""{SALES}, g AS (SELECT country AS dimension, {REVENUE} AS value FROM sales WHERE {_where}
AND country IS NOT NULL GROUP BY 1)
SELECT dimension, round(value, 2) AS value, (SELECT count(*) > 5 FROM g) AS truncated FROM g ORDER BY value DESC, dimension LIMIT 5"""
ORACLES["slice_by_month"] = f"""{SALES}, g AS (SELECT date_trunc('month', order_ts) AS m, {KPI['average_order_value']} AS value
FROM sales WHERE status IN ('F', 'O') AND order_ts >= TIMESTAMP '1999-01-01' AND order_ts < TIMESTAMP '2001-01-01' GROUP BY 1)
SELECT CAST(CAST(m AS TIMESTAMP) AS VARCHAR) AS dimension, round(value, 4) AS value, (SELECT count(*) > 36 FROM g) AS truncated
FROM g ORDER BY m LIMIT 36"""
ORACLES["slice_scalar"] = f"""{SALES} SELECT round({REVENUE}, 2) AS value FROM sales
WHERE customer_id IS NULL AND quantity <= 10 AND status = 'P'"""
_values = union(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS rows FROM sales WHERE {c} IS NOT NULL GROUP BY 2"
                for c in ("country", "segment", "status"))
ORACLES["filter_options"] = f"""{SALES}, v AS ({_values}),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY rows DESC, value) AS rank, count(*) OVER (PARTITION BY dimension) AS n FROM v)
SELECT dimension, 'categorical' AS type, NULL::VARCHAR AS min, NULL::VARCHAR AS max, value, CAST(rows AS DOUBLE) AS rows, CAST(rank AS DOUBLE) AS rank,
  CAST(n AS DOUBLE) AS distinct_values, CAST(n > 100 AS DOUBLE) AS truncated FROM r WHERE rank <= 100
UNION ALL SELECT 'order_ts', 'datetime', CAST(min(order_ts) AS VARCHAR), CAST(max(order_ts) AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM sales"""
ORACLES["relative_range"] = f"""{SALES}, m AS (SELECT CAST(max(order_ts) AS DATE) AS last FROM sales)
SELECT segment AS dimension, CAST(count(*) AS DOUBLE) AS lines, round(sum(quantity), 2) AS units FROM sales, m
WHERE order_ts BETWEEN CAST(date_trunc('month', last) - INTERVAL 6 MONTH + INTERVAL (day(last) - 1) DAY AS TIMESTAMP) AND CAST(last AS TIMESTAMP)
AND segment IS NOT NULL GROUP BY 1"""

# --- Profiles
SALES_KINDS = {"order_id": "other", "product_id": "numeric", "customer_id": "numeric", "quantity": "numeric",
               "unit_price": "numeric", "cost": "numeric", "discount": "numeric", "freight": "numeric",
               "order_ts": "temporal", "country": "other", "segment": "other", "status": "other"}
MESSY_KINDS = {"order_id": "numeric", "customer_id": "numeric", "status": "other", "priority": "other",
               "amount": "numeric", "units": "numeric", "order_ts": "temporal"}


def hints(words) -> str:
    return "regexp_matches(lower(column_name), '" + "|".join(words) + "')"


LOGICAL = f"""CASE WHEN {hints(fixed.DATE_HINTS)} OR kind = 'temporal' THEN 'datetime'
WHEN kind = 'numeric' AND {hints(fixed.MONEY_HINTS)} THEN 'currency' WHEN kind = 'numeric' AND {hints(fixed.QTY_HINTS)} THEN 'quantity'
WHEN kind = 'numeric' AND {hints(fixed.ID_HINTS)} AND distinct_count >= greatest(1, floor(row_count * 0.9)) THEN 'identifier'
WHEN kind = 'numeric' THEN 'numeric' WHEN {hints(fixed.GEO_HINTS)} THEN 'geo'
WHEN distinct_count > 0 AND distinct_count <= greatest(20, floor(row_count * 0.05)) THEN 'categorical'
WHEN {hints(fixed.ID_HINTS)} THEN 'identifier' ELSE 'text' END"""
HINT = """CASE logical_type WHEN 'currency' THEN 'measure.revenue_like' WHEN 'quantity' THEN 'measure.quantity'
WHEN 'datetime' THEN 'dimension.time' WHEN 'geo' THEN 'dimension.geo' WHEN 'categorical' THEN 'dimension.category'
WHEN 'identifier' THEN 'identifier' ELSE CASE WHEN column_name LIKE '%status%' THEN 'dimension.status'
WHEN column_name LIKE '%customer%' THEN 'entity.customer' WHEN column_name LIKE '%product%' THEN 'entity.product'
WHEN column_name LIKE '%order%' THEN 'entity.order' ELSE logical_type END END"""
NO = "CAST(NULL AS DOUBLE)"


def gap_label(source: str, column: str) -> str:
    return f"""(SELECT CASE WHEN count(g) < 2 THEN 'unknown' WHEN median(g) < 1 THEN 'hour_or_finer' WHEN median(g) <= 2 THEN 'day'
    WHEN median(g) <= 10 THEN 'week' WHEN median(g) <= 40 THEN 'month' ELSE 'year' END
    FROM (SELECT floor(epoch(t - lag(t) OVER (ORDER BY t)) / 86400) AS g FROM (SELECT {column} AS t FROM {source} WHERE {column} IS NOT NULL)))"""


def nearest(source: str, column: str, q: float) -> str:
    return f"""(SELECT v FROM (SELECT CAST({column} AS DOUBLE) AS v, row_number() OVER (ORDER BY {column}) AS k, count(*) OVER () AS n
    FROM {source} WHERE {column} IS NOT NULL) WHERE k = floor((n - 1) * {q} + 0.5) + 1)"""


def stats_of(table: str, source: str, kinds: dict[str, str]) -> str:
    """CTEs ``s`` (figures per column) and ``p`` (with logical types and flags)."""
    parts = []
    for i, (c, kind) in enumerate(kinds.items()):
        number = kind == "numeric"
        agg = lambda f: f"CAST({f}({c}) AS DOUBLE)" if number else NO
        parts.append(f"""SELECT '{c}' AS column_name, {i} AS position, '{kind}' AS kind, count(*) AS row_count, count(*) - count({c}) AS null_count,
        count({c}) AS value_count, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS distinct_count,
        {agg('avg')} AS mean, {agg('stddev_samp')} AS std, {agg('min')} AS min, {agg('max')} AS max,
        {f"count(*) FILTER ({c} < 0)" if number else "CAST(NULL AS BIGINT)"} AS negative_count,
        {f"CAST(min({c}) AS VARCHAR)" if kind == "temporal" else "CAST(NULL AS VARCHAR)"} AS min_date,
        {f"CAST(max({c}) AS VARCHAR)" if kind == "temporal" else "CAST(NULL AS VARCHAR)"} AS max_date,
        {gap_label(source, c) if kind == "temporal" else "CAST(NULL AS VARCHAR)"} AS granularity FROM {source}""")
    quart = []
    for c, kind in kinds.items():
        if kind == "numeric":
            quart.append(f"SELECT '{c}' AS column_name, {nearest(source, c, 0.25)} AS q25, {nearest(source, c, 0.5)} AS q50, {nearest(source, c, 0.75)} AS q75")
    outliers = union(f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) AS outlier_count_iqr
        FROM {source}, q WHERE q.column_name = '{c}' AND q75 > q25""" for c, kind in kinds.items() if kind == "numeric")
    return f"""s AS ({union(parts)}), q AS ({union(quart)}), o AS ({outliers}),
    l AS (SELECT s.*, q25, q50, q75, outlier_count_iqr, {LOGICAL} AS logical_type,
      null_count * 100.0 / row_count AS raw_null, distinct_count * 100.0 / row_count AS raw_unique
      FROM s LEFT JOIN q USING (column_name) LEFT JOIN o USING (column_name)),
    p AS (SELECT '{table}' AS table_name, *, {HINT} AS semantic_hint, round(raw_null, 4) AS null_pct, round(raw_unique, 4) AS uniqueness_pct,
      raw_unique >= 99.5 AND null_count = 0 AS is_candidate_pk,
      (column_name LIKE '%id%' OR column_name LIKE '%\\_fk' ESCAPE '\\') AND NOT (raw_unique >= 99.5 AND null_count = 0) AND raw_unique >= 1 AS is_candidate_fk,
      concat_ws('; ', CASE WHEN outlier_count_iqr > 0.05 * value_count THEN 'High outlier rate by IQR' END,
        CASE WHEN min < 0 AND column_name LIKE '%id%' THEN 'Negative values in identifier-like column' END,
        CASE WHEN raw_null > 40 THEN 'High missingness' END,
        CASE WHEN raw_unique = 100 AND row_count > 1 AND logical_type = 'text' THEN 'All values unique — possible identifier' END) AS warnings
      FROM l)"""


SALES_P = f"{SALES}, {stats_of('sales', 'sales', SALES_KINDS)}"
MESSY_P = f"{MESSY}, {stats_of('orders', 'orders_m', MESSY_KINDS)}"
ORACLES["profile_columns"] = f"""{SALES_P} SELECT table_name, column_name, logical_type, semantic_hint, row_count, null_count, null_pct,
distinct_count, uniqueness_pct, is_candidate_pk, is_candidate_fk, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min,
round(max, 4) AS max, CAST(negative_count AS DOUBLE) AS negative_count, min_date, max_date, granularity, warnings FROM p"""
ORACLES["profile_quantiles"] = f"""{SALES_P} SELECT column_name, value_count, round(q25, 4) AS q25, round(q50, 4) AS q50,
round(q75, 4) AS q75, round(q50, 4) AS median, outlier_count_iqr FROM p WHERE kind = 'numeric'"""


def top_values(source: str, kinds: dict[str, str]) -> str:
    counts = union(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS count FROM {source} WHERE {c} IS NOT NULL GROUP BY 2"
                   for c, kind in kinds.items() if kind == "other")
    return f"""SELECT * FROM (SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS place, value, count
    FROM ({counts})) WHERE place <= 10"""


ORACLES["profile_top_values"] = f"{SALES} {top_values('sales', SALES_KINDS)}"
_first = union(f"""SELECT '{c}' AS column_name, string_agg(CAST(v AS VARCHAR), '|' ORDER BY v) AS sample_values
FROM (SELECT DISTINCT {c} AS v FROM sales WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)"""
               for c in ("order_id", "country", "segment", "status", "product_id", "order_ts"))
ORACLES["profile_samples"] = f"{SALES} {_first}"
_cells = " + ".join(f"count(*) - count({c})" for c in MESSY_KINDS)
_nulls = " + ".join(f"round((count(*) - count({c})) * 100.0 / count(*), 4)" for c in MESSY_KINDS)
MESSY_T = f"""t AS (SELECT 'orders' AS table_name, count(*) AS row_count, CAST({len(MESSY_KINDS)} AS BIGINT) AS column_count,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_m)) AS duplicate_row_count, {_cells} AS null_cells, ({_nulls}) / {len(MESSY_KINDS)} AS mean_null
FROM orders_m)"""
ORACLES["profile_table"] = f"""{MESSY}, {MESSY_T} SELECT table_name, row_count, column_count, duplicate_row_count,
round((100 - mean_null) * 0.6 + (100 - duplicate_row_count * 100.0 / row_count) * 0.4, 2) AS quality_score,
CASE WHEN duplicate_row_count > 0 THEN duplicate_row_count || ' duplicate rows detected' ELSE '' END AS warnings FROM t"""
ORACLES["profile_summary"] = f"""{MESSY_P}, tops AS ({top_values('orders_m', MESSY_KINDS)}),
sums AS (SELECT round(avg(null_pct), 4) AS mean_null_pct, count(*) FILTER (warnings <> '' OR null_pct > 5 OR coalesce(outlier_count_iqr, 0) > 0) AS columns_with_issues,
count(*) FILTER (logical_type IN ('currency', 'quantity', 'numeric')) AS measures FROM p)
SELECT 'orders' AS table_name, column_name, max(value) FILTER (place = 1) AS top_value,
round(max(count) FILTER (place = 1) * 100.0 / sum(count), 4) AS share_pct, any_value(mean_null_pct) AS mean_null_pct,
any_value(columns_with_issues) AS columns_with_issues, any_value(measures) AS measures FROM tops, sums GROUP BY column_name"""
ORACLES["date_granularity"] = union(f"SELECT '{n}' AS column_name, {gap_label(s, c)} AS granularity" for n, s, c in (
    ("o_orderdate", "orders", "o_orderdate"), ("order_days", "(SELECT DISTINCT o_orderdate FROM orders)", "o_orderdate"),
    ("order_months", "(SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m FROM orders)", "m"), ("ts", "events", "ts")))

_contacts = """(SELECT concat(lower(c_name), '@example.com') AS contact, concat('+1 ', lpad(CAST(c_custkey AS VARCHAR), 10, '5')) AS line,
c_mktsegment, concat(lpad(hex(c_custkey), 8, '0'), '-0000-4000-8000-000000000000') AS token FROM customer)"""
PII_TABLES = {
    "customer": ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "documents": ("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
    "conversations": ("conversations", ["conv_id", "turn", "role", "text"]),
    "pages": ("pages", ["page_id", "url", "html"]),
    "supplier": ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "contacts": (_contacts, ["contact", "line", "c_mktsegment", "token"]),
}
_shares = union(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n, avg(CAST(regexp_matches(v, '{fixed.EMAIL}') AS INT)) AS email,
avg(CAST(regexp_matches(v, '{fixed.PHONE}') AND length(regexp_replace(v, '\\D', '', 'g')) >= 8 AS INT)) AS phone,
avg(CAST(regexp_matches(v, '{fixed.UUID}') AS INT)) AS uuid FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {s}) WHERE v <> ''"""
                for t, (s, columns) in PII_TABLES.items() for c in columns)
ORACLES["pii_scan"] = f"""WITH shares AS ({_shares}), k AS (SELECT *, CASE WHEN column_name LIKE '%email%' OR email >= 0.5 THEN 'email'
WHEN column_name LIKE '%phone%' OR column_name LIKE '%mobile%' OR phone >= 0.5 THEN 'phone' WHEN {hints(fixed.NAME_HINTS)} THEN 'name'
WHEN {hints(fixed.ADDRESS_HINTS)} THEN 'address' WHEN {hints(fixed.NATIONAL_ID_HINTS)} THEN 'national_id' WHEN uuid >= 0.5 THEN 'identifier' END AS pii_type FROM shares WHERE n > 0)
SELECT table_name, column_name, pii_type, CAST(CASE pii_type WHEN 'email' THEN 0.95 WHEN 'phone' THEN 0.85 WHEN 'name' THEN 0.7
WHEN 'address' THEN 0.7 WHEN 'national_id' THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence FROM k WHERE pii_type IS NOT NULL"""
ORACLES["pii_mask"] = """SELECT c_custkey, concat(left(lower(c_name), 1), '***@example.com') AS mail,
concat('***', right(lpad(CAST(c_custkey AS VARCHAR), 10, '5'), 4)) AS phone, concat(left(c_name, 1), '***', right(c_name, 1)) AS name,
'***' AS short FROM customer"""

# --- Type inference
TEXT_ORDERS = """t AS (SELECT strftime(o_orderdate, '%-m/%-d/%Y %-H:%M') AS us_time, strftime(o_orderdate, '%d/%m/%Y') AS eu_date,
strftime(make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate) % 12 + 1), '%m/%d/%Y') AS unsure_date,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS iso_time,
CASE WHEN o_orderkey % 50 = 3 THEN '2001-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dirty_date,
CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS mixed_date,
format('{:,.2f}', o_totalprice) AS total_text, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS plain_total,
CASE WHEN o_orderkey % 50 = 3 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS dirty_total,
lpad(CAST(o_orderkey % 100000 AS VARCHAR), 6, '0') AS padded, CAST(o_custkey AS VARCHAR) AS account_no, o_orderpriority, o_totalprice FROM orders)"""
SHAPES = {"%Y": r"\d{4}", "%y": r"\d{2}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%b": "[A-Za-z]{3}", "%H": r"\d{1,2}", "%M": r"\d{1,2}", "%S": r"\d{1,2}"}


def swap(fmt: str) -> str | None:
    if "%m/%d" in fmt or "%m-%d" in fmt:
        return fmt.replace("%m/%d", "%d/%m").replace("%m-%d", "%d-%m")
    if "%d/%m" in fmt or "%d-%m" in fmt or "%d.%m" in fmt:
        return fmt.replace("%d/%m", "%m/%d").replace("%d-%m", "%m-%d")
    return None


def parses(column: str, fmt: str) -> str:
    shape = fmt.replace("%.f", r"(\.\d{1,9})?") if "%.f" in fmt else fmt.replace(".", r"\.")
    for letter, pattern in SHAPES.items():
        shape = shape.replace(letter, pattern)
    text = f"regexp_replace({column}, '\\.\\d+$', '')" if "%.f" in fmt else column
    return f"(regexp_full_match({column}, '{shape}') AND try_strptime({text}, '{fmt.replace('%.f', '')}') IS NOT NULL)"


ALL_FORMATS = list(dict.fromkeys(fixed.DATE_FORMATS + [s for s in map(swap, fixed.DATE_FORMATS) if s]))


def rates(columns) -> str:
    return union(f"SELECT '{c}' AS column_name, '{f}' AS format, {i} AS idx, avg(CAST({parses(c, f)} AS DOUBLE)) AS rate FROM t"
                 for c in columns for i, f in enumerate(ALL_FORMATS))


ORACLES["infer_format_rates"] = f"""WITH {TEXT_ORDERS} SELECT column_name, format, round(rate, 6) AS parse_rate
FROM ({rates(["us_time", "eu_date", "unsure_date", "iso_time", "mixed_date"])}) WHERE rate > 0"""
TEXTS = ["us_time", "eu_date", "unsure_date", "iso_time", "dirty_date", "mixed_date", "total_text", "plain_total", "dirty_total",
         "padded", "account_no", "o_orderpriority"]
DATED = TEXTS[:6]
_parts = lambda c: f"regexp_extract({c}, '{fixed.DATE_PARTS}', ['a', 'b', 'c'])"
_proof = lambda c, part: f"""bool_or(coalesce(length({_parts(c)}.a) BETWEEN 1 AND 3 AND length({_parts(c)}.c) IN (2, 4) AND TRY_CAST({_parts(c)}.{part} AS INT) > 12, false))"""
_number = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
_seen = union(f"""SELECT '{c}' AS column_name, count({c}) AS n, avg(CAST(regexp_matches({c}, '{fixed.DATE_SHAPE}') AS INT)) AS dates,
avg(CAST(regexp_matches({c}, '{fixed.NUMBER_SHAPE.replace("'", "''")}') AS INT)) AS numbers, bool_or(regexp_matches({c}, '{fixed.LEADING_ZERO}')) AS zeros,
greatest(avg(CAST(regexp_matches({c}, '{_number}') AS INT)), avg(CAST(regexp_matches(regexp_replace({c}, '[\\s,'']', '', 'g'), '{_number}') AS INT))) AS numeric_rate,
{_proof(c, 'a')} AS day_first, {_proof(c, 'b')} AS month_first FROM t""" for c in TEXTS)
_swaps = ", ".join(f"('{f}', '{swap(f) or ''}', {'%m/%d' in f or '%m-%d' in f}, {'%d/%m' in f or '%d-%m' in f or '%d.%m' in f})" for f in fixed.DATE_FORMATS)
INFER = f"""WITH {TEXT_ORDERS}, seen AS ({_seen}), r AS ({rates(DATED)}), f(format, other, mf, df) AS (VALUES {_swaps}),
c AS (SELECT r.*, f.other, s.day_first, s.month_first FROM r JOIN f USING (format) JOIN seen s USING (column_name)
  WHERE rate > 0 AND s.dates >= 0.8 AND NOT (s.day_first AND NOT s.month_first AND mf) AND NOT (s.month_first AND NOT s.day_first AND df)),
k AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rate DESC, idx) AS place FROM c
  WHERE idx <= coalesce((SELECT min(z.idx) FROM c z WHERE z.column_name = c.column_name AND z.rate = 1), 999)),
b AS (SELECT k.*, NOT day_first AND NOT month_first AND other <> '' AND abs((SELECT z.rate FROM r z WHERE z.column_name = k.column_name AND z.format = k.other) - k.rate) < 1e-9 AS unsure
  FROM k WHERE place = 1),
d AS (SELECT seen.column_name, n, dates, numbers, zeros, numeric_rate, b.format, b.rate, coalesce(unsure, false) AS unsure, seen.day_first AND seen.month_first AS mixed,
  seen.column_name IN ('padded', 'account_no') AND regexp_matches(seen.column_name, 'account') AS keyed FROM seen LEFT JOIN b USING (column_name)),
e AS (SELECT column_name, CASE WHEN dates >= 0.8 AND rate >= 0.95 THEN 'parse_datetime'
    WHEN dates < 0.8 AND numbers >= 0.8 AND numeric_rate = 1 AND NOT zeros AND NOT keyed THEN 'cast_numeric' ELSE 'keep' END AS action,
  CASE WHEN dates >= 0.8 THEN format END AS format,
  CASE WHEN dates >= 0.8 THEN round(rate, 6) WHEN numbers >= 0.8 THEN round(numeric_rate, 6) END AS parse_rate, n AS sample_size,
  CAST(CASE WHEN dates >= 0.8 THEN coalesce(CAST(mixed AS INT), 0) + CAST(unsure AS INT) + CAST(coalesce(rate, 0) < 1 AS INT) WHEN numbers >= 0.8 THEN CAST(numeric_rate < 1 AS INT) ELSE 0 END AS BIGINT) AS warnings,
  dates >= 0.8 AND unsure AS unsure FROM d
  UNION ALL SELECT 'o_totalprice', 'keep', NULL, NULL, 0, 0, false)"""
ORACLES["infer_decisions"] = f"{INFER} SELECT column_name, action, format, parse_rate, sample_size, warnings, unsure FROM e"
ORACLES["quality_decision_issues"] = f"""{INFER} SELECT column_name, 'unparsed_dates' AS issue_type, CASE WHEN parse_rate < 0.99 THEN 'high' ELSE 'low' END AS severity,
CAST(0 AS BIGINT) AS rows_affected FROM e WHERE action = 'parse_datetime' AND parse_rate < 1
UNION ALL SELECT column_name, 'ambiguous_type', 'low', 0 FROM e WHERE action = 'keep' AND warnings > 0 AND parse_rate > 0
UNION ALL SELECT column_name, 'ambiguous_date_order', 'high', 0 FROM e WHERE action = 'parse_datetime' AND unsure"""
_dates = {"us_time": "o_orderdate", "eu_date": "o_orderdate", "unsure_date": "make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate) % 12 + 1)",
          "iso_time": "o_orderdate", "dirty_date": "CASE WHEN o_orderkey % 50 <> 3 THEN o_orderdate END"}
ORACLES["infer_apply"] = "SELECT " + ", ".join(
    [f"CAST({f}(CAST({e} AS TIMESTAMP)) AS VARCHAR) AS {f}_{c}" for f in ("min", "max") for c, e in _dates.items()]
    + [f"count({e}) AS n_{c}" for c, e in _dates.items()]
) + """, round(sum(o_totalprice), 2) AS total_text, round(sum(o_totalprice), 2) AS plain_total, count(*) AS dirty_total,
max(lpad(CAST(o_orderkey % 100000 AS VARCHAR), 6, '0')) AS padded FROM orders"""

# --- Quality and cleanup
_pad = "(status <> trim(status))"
ISSUES = f"""i AS (
SELECT table_name, column_name, 'missing_values' AS issue_type, CASE WHEN null_pct < 20 THEN 'low' WHEN null_pct < 50 THEN 'medium' ELSE 'high' END AS severity,
  null_count AS rows_affected, 'null_count' AS detection_method FROM p WHERE null_pct >= 5
UNION ALL SELECT 'orders', 'status', 'whitespace', 'low', count(*), 'trim comparison' FROM orders_m WHERE {_pad}
UNION ALL SELECT 'orders', 'status', 'empty_string', 'low', count(*), 'empty string count' FROM orders_m WHERE status = ''
UNION ALL SELECT table_name, column_name, 'impossible_values', 'medium', negative_count, 'domain rule: currency >= 0' FROM p WHERE logical_type = 'currency' AND min < 0
UNION ALL SELECT table_name, column_name, 'returns_present', 'medium', negative_count, 'negative quantity count' FROM p WHERE logical_type = 'quantity' AND negative_count > 0
UNION ALL SELECT table_name, column_name, 'outliers', 'low', outlier_count_iqr, 'IQR 1.5' FROM p WHERE outlier_count_iqr > 0
UNION ALL SELECT table_name, NULL, 'duplicates', CASE WHEN duplicate_row_count < 0.05 * row_count THEN 'medium' ELSE 'high' END, duplicate_row_count, 'full-row uniqueness' FROM t WHERE duplicate_row_count > 0)"""
MESSY_Q = f"{MESSY_P}, {MESSY_T}, {ISSUES}"
SCORES = f"""z AS (SELECT row_count, 100 * (1 - null_cells / (row_count * column_count)) AS completeness, 100 * (1 - duplicate_row_count / row_count) AS uniqueness,
greatest(0, 100 - coalesce((SELECT sum(least(15.0, rows_affected * 100.0 / row_count)) FROM i WHERE issue_type = 'whitespace'), 0)) AS consistency,
greatest(0, 100 - coalesce((SELECT sum(CASE issue_type WHEN 'empty_string' THEN least(10.0, rows_affected * 100.0 / row_count) ELSE 10.0 END) FROM i WHERE issue_type IN ('empty_string', 'impossible_values')), 0)) AS validity,
100.0 AS referential_integrity FROM t),
scores AS (SELECT 'orders' AS table_name, CAST(round(completeness * 0.3 + uniqueness * 0.2 + consistency * 0.2 + validity * 0.2 + referential_integrity * 0.1, 2) AS DOUBLE) AS overall,
CAST(round(completeness, 2) AS DOUBLE) AS completeness, CAST(round(uniqueness, 2) AS DOUBLE) AS uniqueness, CAST(round(consistency, 2) AS DOUBLE) AS consistency,
CAST(round(validity, 2) AS DOUBLE) AS validity, CAST(round(referential_integrity, 2) AS DOUBLE) AS referential_integrity FROM z)"""
ORACLES["quality_issues"] = f"{MESSY_Q} SELECT * FROM i"
ORACLES["quality_scorecard"] = f"{MESSY_Q}, {SCORES} SELECT * FROM scores"
ORACLES["quality_run_score"] = f"{MESSY_Q}, {SCORES} SELECT round(avg(overall), 2) AS overall_score, count(*) AS tables FROM scores"
ORACLES["clean_apply"] = f"""WITH m AS ({views.duck(views.MESSY_ORDERS)}) SELECT order_id, CAST(customer_id AS DOUBLE) AS customer_id, nullif(trim(status), '') AS status, priority, amount, units,
CAST(order_ts AS VARCHAR) AS order_ts FROM m"""
ORACLES["clean_log"] = f"""WITH m AS ({views.duck(views.MESSY_ORDERS)})
SELECT CAST(0 AS INT) AS step, 'drop_duplicates' AS operation, NULL::VARCHAR AS column_name, count(*) FILTER (order_id % 13 = 0) AS rows_affected, NULL::VARCHAR AS before_example, NULL::VARCHAR AS after_example FROM m
UNION ALL SELECT 1, 'trim_whitespace', 'status', count(*), min(status), trim(min(status)) FROM m WHERE {_pad}
UNION ALL SELECT 2, 'empty_to_null', 'status', count(*), '', NULL FROM m WHERE trim(status) = ''"""
_amount = "CASE WHEN o_orderkey % 50 <> 3 THEN o_totalprice END"
_rows = " UNION ALL ".join(f"SELECT '{op}' AS item, count(*) AS rows, NULL::DOUBLE AS total, NULL::VARCHAR AS last FROM orders" for op in (
    "normalize_case o_orderpriority", "cast_numeric plain_total", "cast_numeric dirty_total", "cast_datetime us_time"))
ORACLES["clean_explicit_steps"] = f"""SELECT lower(o_orderpriority) AS item, count(*) AS rows, round(sum({_amount}), 2) AS total, CAST(max(o_orderdate) AS VARCHAR) AS last FROM orders GROUP BY 1
UNION ALL {_rows} UNION ALL SELECT 'drop_all_null_rows', count(*), NULL, NULL FROM orders WHERE month(o_orderdate) = 1 AND day(o_orderdate) = 1"""

# --- Joins
JOIN_TABLES = {"customers": (views.DIM_CUSTOMER, {"customer_id": "n", "customer_name": "s", "segment": "s", "nation_id": "n"}),
               "orders": (views.FACT_ORDERS, {"order_id": "n", "customer_id": "n", "status": "s", "amount": "n"}),
               "lines": (views.FACT_LINES, {"order_id": "n", "product_id": "n", "supplier_id": "n", "quantity": "n"}),
               "nations": (views.DIM_NATION, {"nation_id": "n", "nation_name": "s"})}
_names = list(JOIN_TABLES)
_pairs = []
for _i, _a in enumerate(_names):
    for _b in _names[_i + 1:]:
        for _x, _tx in JOIN_TABLES[_a][1].items():
            for _y, _ty in JOIN_TABLES[_b][1].items():
                _near = _x == _y or (_x.endswith("_id") and _y.endswith("_id")) or _x in _y or _y in _x
                if _near and _tx == _ty:
                    _pairs.append((_a, _x, _b, _y))
_over = union(f"""SELECT '{a}' AS source_table, '{x}' AS source_column, '{b}' AS target_table, '{y}' AS target_column,
(SELECT count(*) FROM (SELECT {x} FROM v_{a} WHERE {x} IS NOT NULL INTERSECT SELECT {y} FROM v_{b} WHERE {y} IS NOT NULL)) AS shared_values,
(SELECT count(DISTINCT {x}) FROM v_{a}) AS dl, (SELECT count(DISTINCT {y}) FROM v_{b}) AS dr, (SELECT CAST(count(*) > count({x}) AS BIGINT) FROM v_{a}) AS nl,
(SELECT count(*) FROM v_{a}) AS rl, (SELECT count(*) FROM v_{b}) AS rr""" for a, x, b, y in _pairs)
JOINS = "WITH " + ", ".join(f"v_{n} AS ({sql})" for n, (sql, _) in JOIN_TABLES.items()) + f""", w AS ({_over}),
g AS (SELECT *, shared_values / least(dl, dr) AS o, dl / rl AS lu, dr / rr AS ru FROM w WHERE dl > 0 AND dr > 0)"""
ORACLES["join_candidates"] = f"""{JOINS} SELECT source_table, source_column, target_table, target_column, round(o, 4) AS overlap_ratio, round(lu, 4) AS source_uniqueness,
round(ru, 4) AS target_uniqueness, CASE WHEN lu >= 0.95 AND ru >= 0.95 THEN 'one_to_one' WHEN lu >= 0.95 THEN 'one_to_many' WHEN ru >= 0.95 THEN 'many_to_one' ELSE 'many_to_many' END AS cardinality,
round(least(1.0, o * 0.75 + least(lu, ru) * 0.1 + CASE WHEN source_column = target_column THEN 0.15 ELSE 0 END), 4) AS confidence, o >= 0.6 AS validated, shared_values FROM g WHERE o >= 0.6"""
ORACLES["orphan_values"] = f"""{JOINS} SELECT source_table AS table_name, source_column AS column_name,
CASE WHEN (dl - shared_values) / (dl + nl) < 0.1 THEN 'medium' ELSE 'high' END AS severity, dl - shared_values AS rows_affected,
target_table || '.' || target_column AS target FROM g WHERE o >= 0.6 AND dl > shared_values"""

# --- Roles
_roles = []
for _role, _kind, _patterns, _types, _out in fixed.ROLES:
    _ts = ", ".join(f"'{t}'" for t in _types)
    _bonus = {"identifier": "CASE WHEN distinct_count > 0 AND distinct_count < row_count THEN 0.15 ELSE 0 END - CASE WHEN null_pct > 50 THEN 0.25 ELSE 0 END",
              "measure": "CASE WHEN mean IS NOT NULL THEN 0.1 ELSE 0 END - CASE WHEN is_candidate_pk THEN 0.5 ELSE 0 END",
              "dimension": "CASE WHEN logical_type = 'datetime' THEN 0.1 WHEN distinct_count > 200 THEN -0.3 ELSE 0.1 END"}[_kind]
    _exact = ", ".join(f"'{n}'" for n in {_role, _role.replace("_", ""), _role.replace("_id", "")})
    _roles.append(f"""SELECT '{_role}' AS role, column_name, position, round(CAST(greatest(0, least(1, 0.55 + CASE WHEN logical_type IN ({_ts}) THEN 0.25 ELSE -0.2 END + {_bonus}
    + CASE WHEN column_name IN ({_exact}) THEN 0.2 ELSE 0 END)) AS DOUBLE), 4) AS confidence FROM p
    WHERE regexp_matches(column_name, '{"|".join(_patterns)}') AND NOT regexp_matches(column_name, '{"|".join(_out)}')""")
ROLE_S = f"{SALES_P}, rs AS (SELECT * FROM ({union(_roles)}) WHERE confidence > 0.5)"
ORACLES["role_scores"] = f"{ROLE_S} SELECT role, column_name, confidence FROM rs"
ORACLES["returns_convention"] = f"""{SALES} SELECT true AS has_negative_quantity, count(*) FILTER (quantity < 0) AS negative_quantity_rows,
round(count(*) FILTER (quantity < 0) / count(*), 6) AS negative_quantity_share, 'C' AS cancel_prefix,
count(*) FILTER (order_id LIKE 'C%') AS cancel_prefix_rows, round(count(*) FILTER (order_id LIKE 'C%') / count(order_id), 6) AS prefix_share
FROM sales HAVING count(*) FILTER (regexp_matches(order_id, '^[A-Za-z]')) < count(order_id) * 0.5"""
CHART = """ch AS (SELECT table_name, column_name, logical_type, distinct_count,
round(CAST(CASE WHEN logical_type = 'datetime' THEN 0.9 WHEN logical_type IN ('geo', 'categorical') AND distinct_count <= 200 THEN 0.8 - least(0.3, distinct_count / 800) END AS DOUBLE), 4) AS confidence
FROM p WHERE NOT is_candidate_pk)"""
ORACLES["chart_dimensions"] = f"{SALES_P}, {CHART} SELECT * FROM ch WHERE confidence IS NOT NULL"
ORACLES["model_items"] = f"""{SALES_P}, {CHART} SELECT 'dimension' AS item, column_name, logical_type AS kind FROM ch WHERE confidence IS NOT NULL
UNION ALL SELECT 'measure', column_name, CASE WHEN logical_type = 'numeric' THEN 'AVG' ELSE 'SUM' END FROM p
WHERE logical_type IN ('currency', 'quantity', 'numeric') AND NOT is_candidate_pk"""
_scores = ", ".join("{{'score': {s}, 'place': {p}, 'domain': '{d}', 'terms': list_sort(list_filter([{t}], lambda x: contains(blob, x)))}}".format(
    s=" + ".join(f"CAST(contains(blob, '{t}') AS INT)" for t in terms), p=-i, d=d,
    t=", ".join(f"'{t}'" for t in dict.fromkeys(terms))) for i, (d, terms) in enumerate(fixed.DOMAIN_TERMS.items()))
ORACLES["domain_inference"] = f"""WITH b AS (SELECT conv_id, turn, lower(text || ' role ' || role) AS blob FROM conversations),
s AS (SELECT conv_id, turn, list_max([{_scores}]) AS best FROM b)
SELECT conv_id, turn, best.domain AS domain, best.score AS score, array_to_string(best.terms, ',') AS matched_terms, best.domain <> 'general' AND best.score > 0 AS confident FROM s"""

# --- Statistics
POINTS = f"""{SALES}, series AS ({line(pick("net_revenue", "units_sold"), "sales", "order_ts", "quarter", "country")}),
pts AS (SELECT country, kpi, period, value, row_number() OVER w - 1 AS index FROM series WHERE NOT partial AND value IS NOT NULL WINDOW w AS (PARTITION BY country, kpi ORDER BY period))"""
ORACLES["zscore_anomalies"] = f"""{POINTS}, z AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z, count(*) OVER w AS n FROM pts WINDOW w AS (PARTITION BY country, kpi))
SELECT country, kpi, {SHOW}, index, round(value, 4) AS value, round(z, 4) AS zscore, 'zscore' AS method FROM z WHERE n >= 4 AND abs(z) >= 2.0"""
ORACLES["iqr_outliers"] = f"""{POINTS}, b AS (SELECT country, kpi, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM pts GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT country, kpi, {SHOW}, index, round(value, 4) AS value, 'iqr' AS method FROM pts JOIN b USING (country, kpi)
WHERE c <> a AND (value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a))"""
ORACLES["linear_trend"] = f"""{POINTS}, f AS (SELECT country, kpi, count(*) AS points, regr_slope(value, index) AS s, regr_intercept(value, index) AS i, regr_r2(value, index) AS r FROM pts GROUP BY 1, 2)
SELECT country, kpi, points, CASE WHEN points < 3 THEN 'insufficient_data' WHEN r >= 0.2 AND s > 0 THEN 'up' WHEN r >= 0.2 AND s < 0 THEN 'down' ELSE 'flat' END AS direction,
round(s, 4) AS slope, round(i, 4) AS intercept, round(r, 4) AS r2 FROM f"""
ORACLES["peak_trough"] = f"""{POINTS}, f AS (SELECT country, kpi, arg_max(period, (value, -index)) AS pp, max(value) AS pv, arg_min(period, (value, index)) AS tp, min(value) AS tv, count(*) AS periods FROM pts GROUP BY 1, 2)
SELECT country, kpi, CAST(pp AS VARCHAR) AS peak_period, CAST(tp AS VARCHAR) AS trough_period, round(pv, 4) AS peak_value, round(tv, 4) AS trough_value, periods,
round((pv - tv) / abs(CASE WHEN tv <> 0 THEN tv ELSE pv END) * 100, 4) AS amplitude_pct FROM f WHERE periods >= 6 AND pv <> tv"""
PARETO = """g AS (SELECT CAST({d} AS VARCHAR) AS dimension, sum({m}) AS value FROM sales WHERE {d} IS NOT NULL GROUP BY 1 HAVING sum({m}) IS NOT NULL),
c AS (SELECT *, sum(value) OVER (ORDER BY value DESC, dimension ROWS UNBOUNDED PRECEDING) / sum(value) OVER () AS share, row_number() OVER (ORDER BY value DESC, dimension) AS rank FROM g)"""
ORACLES["pareto"] = f"""{SALES}, {PARETO.format(d="product_id", m="quantity")} SELECT dimension, round(value, 6) AS value, round(share, 6) AS cumulative_share,
(SELECT count(*) FILTER (share < 0.8) + 1 FROM c) AS cutoff_count, (SELECT count(*) FROM c) AS groups, rank FROM c WHERE rank <= 25"""
_numeric = [c for c, k in SALES_KINDS.items() if k == "numeric"]
_corr = union(f"SELECT '{a}' AS left, '{b}' AS right, corr({a}, {b}) AS correlation, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS rows FROM sales"
              for i, a in enumerate(_numeric) for b in _numeric[i + 1:])
ORACLES["correlation"] = f"""{SALES} SELECT "left", "right", round(correlation, 6) AS correlation, rows FROM ({_corr.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')})
WHERE rows >= 10 ORDER BY round(abs(correlation), 12) DESC, "left", "right" LIMIT 20"""
ORACLES["row_concentration"] = f"""{SALES}, g AS (SELECT country, count(*) AS n FROM sales WHERE country IS NOT NULL GROUP BY 1)
SELECT 'country' AS dimension, (SELECT country FROM g ORDER BY n DESC, country LIMIT 1) AS top_value, round(max(n) / sum(n), 6) AS share, count(*) AS distinct_values FROM g"""

# --- Findings and audit
_named = ", ".join(f"('{k}', '{n}', '{a}', {p}, {b})" for k, (n, _, a, p, b) in ROW.items())
RUN = f"""{SALES}, names(kpi, name, additivity, priority, better) AS (VALUES {_named}),
series AS ({line(KPI, "sales", "order_ts", "quarter")}), ch AS ({changes("series")}),
val AS ({long(KPI, "sales", "", None)}),
k AS (SELECT names.*, val.value, current_value, previous_value, comparison_period, baseline_period, (current_value - previous_value) / nullif(previous_value, 0) AS change
  FROM names JOIN val USING (kpi) LEFT JOIN ch USING (kpi)),
pts AS (SELECT kpi, period, value, row_number() OVER (PARTITION BY kpi ORDER BY period) - 1 AS index FROM series WHERE NOT partial AND value IS NOT NULL),
tr AS (SELECT kpi, count(*) AS points, regr_slope(value, index) AS slope, regr_r2(value, index) AS r2 FROM pts GROUP BY 1),
pk AS (SELECT kpi, arg_max(period, (value, -index)) AS pp, max(value) AS pv, arg_min(period, (value, index)) AS tp, min(value) AS tv, count(*) AS n FROM pts GROUP BY 1),
chf AS (SELECT 'change' AS rule, kpi, name || CASE WHEN change > 0 THEN ' increased ' ELSE ' decreased ' END || printf('%.1f%%', abs(change) * 100) || ' in ' || CAST(comparison_period AS VARCHAR) AS title,
  'trend' AS category, CASE WHEN abs(change) < 0.2 THEN 'info' ELSE 'warning' END AS severity, CAST(CASE WHEN coalesce(r2, 0) > 0.3 THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence,
  CASE WHEN abs(change) >= 0.15 THEN CASE WHEN (change > 0) = better THEN '{fixed.BASIS["favourable"]}' ELSE '{fixed.BASIS["adverse"]}' END END AS recommendation_basis,
  printf('%+.1f%%', change * 100) || ' vs ' || CAST(baseline_period AS VARCHAR) AS comparison, CAST(comparison_period AS VARCHAR) AS period, change
  FROM k LEFT JOIN tr USING (kpi) WHERE change IS NOT NULL),
trf AS (SELECT 'trend' AS rule, kpi, name || ' trends ' || CASE WHEN slope > 0 THEN 'up' ELSE 'down' END || ' across ' || points || ' periods' AS title, 'trend' AS category, 'info' AS severity,
  round(least(0.95, 0.5 + r2 / 2), 6) AS confidence, NULL::VARCHAR AS recommendation_basis FROM k JOIN tr USING (kpi) WHERE points >= 4 AND r2 >= 0.2 AND slope <> 0),
sef AS (SELECT 'seasonality' AS rule, kpi, name || ' peaks in ' || CAST(pp AS VARCHAR) AS title, 'trend' AS category, 'info' AS severity, CAST(0.7 AS DOUBLE) AS confidence,
  CASE WHEN (pv - tv) / abs(CASE WHEN tv <> 0 THEN tv ELSE pv END) * 100 >= 50 THEN '{fixed.BASIS["seasonality"]}' END AS recommendation_basis FROM k JOIN pk USING (kpi) WHERE n >= 6 AND pv <> tv),
ref AS (SELECT 'return_rate' AS rule, kpi, printf('%.1f%%', value) || ' of orders are cancellations' AS title, 'risk' AS category, 'warning' AS severity, CAST(0.85 AS DOUBLE) AS confidence,
  '{fixed.BASIS["return_rate"]}' AS recommendation_basis FROM k WHERE kpi = 'order_return_rate' AND value >= 5)"""
ORACLES["insights_change"] = f"{RUN} SELECT rule, kpi, title, category, severity, confidence, recommendation_basis, comparison, period FROM chf"
ORACLES["insights_trend_season"] = f"{RUN} SELECT * FROM trf UNION ALL SELECT * FROM sef"
ORACLES["insights_returns"] = f"{RUN} SELECT * FROM ref"
ORACLES["insight_scores"] = f"""{RUN} SELECT kpi, round(0.6 + CASE severity WHEN 'warning' THEN 0.75 ELSE 0.4 END + confidence * 0.5 + CASE WHEN recommendation_basis IS NULL THEN 0 ELSE 0.3 END
+ least(0.6, round(abs(change) * 100, 1) / 100), 4) AS score FROM chf"""
ORACLES["insight_counts"] = f"""{RUN}, u AS (SELECT category, recommendation_basis FROM chf UNION ALL SELECT category, recommendation_basis FROM trf
UNION ALL SELECT category, recommendation_basis FROM sef UNION ALL SELECT category, recommendation_basis FROM ref)
SELECT category, count(*) AS findings, count(*) AS grounded, count(recommendation_basis) AS with_recommendation FROM u GROUP BY 1"""
_group = "CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN segment ELSE 'OTHER' END"
ORACLES["insights_segment"] = f"""{RUN}, parts AS ({long(pick("net_revenue", "units_sold", "returned_value", "average_unit_price"), "sales", f"{_group} AS dimension", None)}),
sh AS (SELECT kpi, dimension, value, abs(value) / nullif(sum(abs(value)) OVER w, 0) AS share, count(*) OVER w AS n, row_number() OVER (PARTITION BY kpi ORDER BY value DESC NULLS LAST, dimension) AS rank
  FROM parts WINDOW w AS (PARTITION BY kpi))
SELECT 'segment' AS rule, kpi, dimension || ' accounts for ' || printf('%.1f%%', share * 100) || ' of ' || name AS title, CASE WHEN share >= 0.6 THEN 'risk' ELSE 'finding' END AS category,
CASE WHEN share >= 0.6 THEN 'warning' ELSE 'info' END AS severity, CAST(0.8 AS DOUBLE) AS confidence, '{fixed.BASIS["concentration"]}' AS recommendation_basis,
printf('%.1f%%', share * 100) || ' of ' || n || ' segments' AS comparison FROM sh JOIN names USING (kpi) WHERE rank = 1 AND n >= 3 AND additivity = 'additive' AND share >= 0.4"""
CLAIMED = "('average_order_value', 'order_return_rate', 'average_unit_price', 'net_revenue')"
ORACLES["claim_grounding"] = f"""{RUN}, v AS ({long(pick("average_order_value", "order_return_rate", "average_unit_price", "net_revenue"), "sales WHERE country IS NOT NULL", "country AS dimension", None)}),
r AS (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY value DESC NULLS LAST, dimension) AS rank FROM v)
SELECT ' ' || upper(name) AS metric, dimension, abs(r.value * 1.002 - k.value) / abs(k.value) < 0.05 AS grounded FROM r JOIN k USING (kpi) WHERE rank <= 15"""
ORACLES["audit_events"] = f"""{RUN} SELECT 'run-1' AS run_id, 'kpi_validation' AS event_type, kpi AS entity, CASE WHEN value IS NULL THEN 'error' ELSE 'info' END AS severity,
'KPI ' || name || ': ' || CASE WHEN value IS NULL THEN 'null_result' ELSE 'computed' END AS message, CASE WHEN value IS NULL THEN 'INVALID' ELSE 'VALID' END AS status FROM k"""
ORACLES["kpi_lineage"] = f"""{RUN}, n(a, b, label) AS (VALUES ('run', 'pipeline_run', 'Run run-1'), ('raw', 'layer', 'RAW'), ('transform', 'transformation', 'TRANSFORM'),
('clean', 'layer', 'CLEAN'), ('semantic', 'semantic', 'SEMANTIC MODEL'), ('kpi', 'kpi', NULL)),
e(a, b, label) AS (VALUES ('run', 'raw', 'input'), ('raw', 'transform', 'profiled'), ('transform', 'clean', 'applied'), ('clean', 'semantic', 'modeled'), ('semantic', 'kpi', 'computed'))
SELECT kpi, 'node' AS item, a, b, coalesce(label, name) AS label FROM k, n UNION ALL SELECT kpi, 'edge', a, b, label FROM k, e"""
_x = "l_extendedprice / pow(10.0, l_orderkey % 7)"
ORACLES["number_wording"] = f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_x} AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v >= 1000 THEN format('{{:,.0f}}', v) WHEN v >= 1 THEN regexp_replace(format('{{:,.2f}}', v), '\\.?0+$', '')
WHEN v = 0 THEN '0' ELSE format('{{:.4g}}', v) END AS wording FROM x"""
ORACLES["dataset_metadata"] = union(f"""SELECT '{t}' AS name, 'parquet' AS source_type, (SELECT count(*) FROM {t}) AS row_count,
(SELECT count(*) FROM (DESCRIBE {t})) AS column_count""" for t in views.TABLES)
ORACLES["full_run"] = f"""{RUN} SELECT kpi, name, 'computed' AS status, round(value, 2) AS value, round(change, 4) AS change_pct FROM k"""

# --- Oracles that build on several of the above
_steps = ["b0 AS (SELECT role, column_name, confidence FROM rs WHERE false)"]
for _i, _role in enumerate(fixed.ROLE_ORDER):
    _steps.append(f"""b{_i + 1} AS (SELECT * FROM b{_i} UNION ALL SELECT * FROM (SELECT role, column_name, confidence FROM rs WHERE role = '{_role}'
    AND column_name NOT IN (SELECT column_name FROM b{_i}) ORDER BY confidence DESC, position LIMIT 1))""")
BOUND = f"{ROLE_S}, {', '.join(_steps)}"
ORACLES["role_bindings"] = f"{BOUND} SELECT role, 'sales' AS table_name, column_name, confidence FROM b{len(fixed.ROLE_ORDER)}"
_expected = ", ".join(f"('{r}')" for r in fixed.EXPECTED_ROLES)
ORACLES["role_notes"] = f"""{BOUND}, w(role) AS (VALUES {_expected}) SELECT role, 'No column bound to role ''' || role || '''; KPIs that need it were not generated.' AS note
FROM w WHERE role NOT IN (SELECT role FROM b{len(fixed.ROLE_ORDER)})"""
_kpis = f"({RUN} SELECT * FROM k)"
_score = f"({MESSY_Q}, {SCORES} SELECT round(avg(overall), 2) AS v FROM scores)"
ORACLES["run_verdict"] = f"""SELECT 'run-1' AS run_id, CASE WHEN done = 0 OR done / n < 0.6 THEN 'retry_semantic' WHEN v <> 0 AND v < 55 THEN 'retry_quality' ELSE 'VALID' END AS status,
done || ' of ' || n || ' KPIs computed, quality ' || printf('%.1f', v) || ', ' || done || ' bound to a value.' AS reason, round(CAST(done / n AS DOUBLE), 4) AS kpi_success_ratio
FROM (SELECT count(*) AS n, count(value) AS done FROM {_kpis}), {_score}"""
_log = f"""(WITH m AS ({views.duck(views.MESSY_ORDERS)}) SELECT 'drop_duplicates on orders (' || count(*) FILTER (order_id % 13 = 0) || ' rows), trim_whitespace on orders.status ('
|| count(*) FILTER ({_pad}) || ' rows), empty_to_null on orders.status (' || count(*) FILTER (trim(status) = '') || ' rows)' AS steps FROM m)"""
_units = ", ".join(f"('{k}', '{u}')" for k, (_, u, _, _, _) in ROW.items())
ORACLES["kpi_explanations"] = f"""WITH u(kpi, unit) AS (VALUES {_units}) SELECT kpi, name || ' evaluated to ' || format('{{:,.2f}}', value) || ' ' || unit || '.' AS what_happened,
'sales' AS data_used, 'No type-inference caveats were raised.' AS quality_limitations, steps AS transformations FROM {_kpis} JOIN u USING (kpi), {_log}"""
ORACLES["evaluation"] = f"""SELECT 'semantic' AS area, 'kpi_formula_validity' AS metric_name, round(avg(CAST(value IS NOT NULL AS DOUBLE)), 4) AS score FROM {_kpis}
UNION ALL SELECT 'dashboard', 'kpis_bound_to_data', round(avg(CAST(value IS NOT NULL AS DOUBLE)), 4) FROM {_kpis}
UNION ALL SELECT 'analyst', 'insight_groundedness', CAST(1 AS DOUBLE) UNION ALL SELECT 'analyst', 'hallucination_rate', CAST(0 AS DOUBLE)
UNION ALL SELECT 'profiler', 'type_inference_resolution', round(avg(CAST(action <> 'keep' OR column_name = 'o_totalprice' AS DOUBLE)), 4) FROM ({INFER} SELECT * FROM e)
UNION ALL SELECT 'semantic', 'vs_naive_baseline', round(CAST({len(KPI)} AS DOUBLE) / count(*), 4) FROM ({SALES_P} SELECT * FROM p WHERE logical_type IN ('currency', 'quantity', 'numeric') AND NOT is_candidate_pk)"""

ORACLES["kpi_quoted_names"] = ORACLES["kpi_scalar_suite"]
ORACLES["kpi_segment_totals"] = f"""{SALES}, v AS ({long(pick("net_revenue", "units_sold"), "sales", "CAST(product_id AS VARCHAR) AS dimension", None)}),
r AS (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY value DESC NULLS LAST, dimension) AS rank, count(*) OVER (PARTITION BY kpi) AS segments,
  sum(abs(coalesce(value, 0))) OVER (PARTITION BY kpi) AS total FROM v)
SELECT kpi, dimension, round(value, 2) AS value, rank, segments, round(total, 2) AS total FROM r WHERE rank <= 15"""
ORACLES["role_bindings_overridden"] = f"""WITH bound AS ({ORACLES["role_bindings"]})
SELECT role, table_name, column_name, confidence FROM bound WHERE role NOT IN ('event_date', 'category')
UNION ALL SELECT 'event_date', 'sales', 'order_ts', 1.0 UNION ALL SELECT 'category', 'sales', 'status', 1.0"""
ORACLES["join_candidates_decimal"] = """SELECT 'a' AS source_table, 'c' AS target_table, CAST(1.0 AS DOUBLE) AS overlap_ratio, count(*) AS shared_values, true AS validated
FROM orders WHERE o_orderkey % 2 = 0"""
ORACLES["csv_read"] = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus || chr(10) || '"' || o_orderpriority || '"; x' AS note, CAST(0 AS BIGINT) AS malformed_count FROM orders"""
ORACLES["layer_round_trip"] = "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
ORACLES["kpi_csv_sink"] = f"""WITH c AS ({ORACLES["kpi_catalogue"]}) SELECT name, value, unit, 'computed' AS status FROM c"""
ORACLES["report_json_sink"] = f"""WITH c AS ({ORACLES["kpi_scalar_suite"]}) SELECT kpi, value, 'computed' AS status FROM c"""

# --- Findings in words, and their ranking


def worded(v: str) -> str:
    """Numbers as findings give them."""
    return (f"CASE WHEN abs({v}) >= 1000 THEN format('{{:,.0f}}', {v}) WHEN abs({v}) >= 1 THEN regexp_replace(format('{{:,.2f}}', {v}), '\\.?0+$', '') "
            f"WHEN {v} = 0 THEN '0' ELSE format('{{:.4g}}', {v}) END")


def percents(v: str, sign: str = "") -> str:
    return f"printf('%{sign}.1f%%', {v} * 100)"


_formulas = ", ".join(f"('{s.slug}', $f${s.measure.text}$f$)" for s in catalogue())
WORDS = f"""{RUN}, formulas(kpi, formula) AS (VALUES {_formulas}),
kk AS (SELECT k.*, formula, r2, points FROM k JOIN formulas USING (kpi) LEFT JOIN tr USING (kpi)),
w_change AS (SELECT 'change' AS rule, kpi, priority * 100 AS position, chf.title, chf.category, chf.severity, chf.confidence, chf.comparison, chf.recommendation_basis,
  CASE WHEN abs(change) >= {fixed.MATERIAL_MOVE} AND (change > 0) <> better THEN name || CASE WHEN change > 0 THEN ' rose ' ELSE ' fell ' END || {percents("abs(change)")} || ' in '
      || period || ' (' || {worded("previous_value")} || ' → ' || {worded("current_value")} || '). Split both periods by segment: a move in every segment points at pricing or demand, a move in one of them at that account or channel.'
    WHEN abs(change) >= {fixed.MATERIAL_MOVE} THEN name || ' improved ' || {percents("abs(change)")} || ' in ' || period || '. '
      || coalesce('The fit over the whole series is R²=' || printf('%.2f', r2) || CASE WHEN r2 >= 0.5 THEN ', consistent enough to plan on. ' ELSE ', which is weak; treat the level as provisional. ' END, '')
      || 'Compare with the same period a year earlier before calling it growth.' END AS recommendation
  FROM chf JOIN (SELECT kpi, name, better, priority, previous_value, current_value, r2 FROM kk) USING (kpi)),
w_trend AS (SELECT rule, kpi, priority * 100 + 1, title, category, severity, confidence, NULL::VARCHAR, recommendation_basis, NULL::VARCHAR FROM trf JOIN names USING (kpi)),
an AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z, count(*) OVER w AS n, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3
  FROM pts WINDOW w AS (PARTITION BY kpi)),
flagged AS (SELECT kpi, period, index, value, z, 'zscore' AS method FROM an WHERE n >= 4 AND abs(z) >= 2.5
  UNION ALL SELECT kpi, period, index, value, NULL, 'iqr' FROM an WHERE n >= 4 AND q3 <> q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))),
odd AS (SELECT * FROM flagged QUALIFY row_number() OVER (PARTITION BY kpi ORDER BY abs(coalesce(z, 0)) DESC, z IS NULL, index) = 1),
w_anomaly AS (SELECT 'anomaly', kpi, priority * 100 + 2, 'Anomalous ' || name || ' in ' || CAST(period AS VARCHAR), 'anomaly', 'warning', CAST(0.75 AS DOUBLE), NULL::VARCHAR, method || ' outlier',
  name || ' reached ' || {worded("odd.value")} || ' in ' || CAST(period AS VARCHAR) || ', outside the range of the other ' || greatest(coalesce(points, 1) - 1, 0) || ' periods by the ' || method
    || ' test. Confirm the cause first: a partial load, one large order and a promotion all look like this.' FROM odd JOIN kk USING (kpi)),
w_return AS (SELECT rule, kpi, priority * 100 + 3, title, category, severity, confidence, NULL::VARCHAR, recommendation_basis,
  title || coalesce(', worth ' || (SELECT {worded("abs(value)")} FROM k WHERE kpi = 'returned_value' AND value <> 0), '') || '. Split them by product and by country: a few products point at listing or quality, an even spread at fulfilment or expectations.'
  FROM ref JOIN names USING (kpi)),
parts AS ({long(KPI, "sales WHERE country IS NOT NULL", "country AS dimension", None)}),
sh AS (SELECT kpi, dimension, value AS part, abs(value) / nullif(sum(abs(value)) OVER w, 0) AS share, count(*) OVER w AS n, row_number() OVER (PARTITION BY kpi ORDER BY value DESC NULLS LAST, dimension) AS rank
  FROM parts WINDOW w AS (PARTITION BY kpi)),
w_segment AS (SELECT 'segment', kpi, priority * 100 + 4, dimension || ' accounts for ' || {percents("share")} || ' of ' || name, CASE WHEN share >= 0.6 THEN 'risk' ELSE 'finding' END,
  CASE WHEN share >= 0.6 THEN 'warning' ELSE 'info' END, CAST(0.8 AS DOUBLE), {percents("share")} || ' of ' || n || ' segments', '{fixed.BASIS["concentration"]}',
  dimension || ' carries ' || {percents("share")} || ' of ' || name || '. A 10% fall there takes away about ' || {worded("(part * 0.1)")}
    || '; size that against the plan. If the concentration is not intended, look at what limits the other segments.'
  FROM sh JOIN names USING (kpi) WHERE rank = 1 AND n >= 3 AND additivity = 'additive' AND share >= {fixed.CONCENTRATION_FLOOR}),
w_season AS (SELECT rule, kpi, priority * 100 + 5, title, category, severity, confidence, NULL::VARCHAR, recommendation_basis,
  CASE WHEN recommendation_basis IS NOT NULL THEN name || ' swings ' || printf('%.0f', (pv - tv) / abs(CASE WHEN tv <> 0 THEN tv ELSE pv END) * 100) || '% between ' || CAST(tp AS VARCHAR) || ' and ' || CAST(pp AS VARCHAR)
    || '. Plan for the ' || CAST(pp AS VARCHAR) || ' peak rather than the average, and compare months with the same month a year before.' END FROM sef JOIN names USING (kpi) JOIN pk USING (kpi)),
pg AS (SELECT country AS g, sum(quantity) AS v FROM sales WHERE country IS NOT NULL GROUP BY 1 HAVING v IS NOT NULL),
pc AS (SELECT g, sum(v) OVER (ORDER BY v DESC, g) / (SELECT sum(v) FROM pg) AS share FROM pg),
cut AS (SELECT count(*) FILTER (share < 0.8) + 1 AS c, count(*) AS n FROM pc),
w_pareto AS (SELECT 'pareto', NULL::VARCHAR, 100000, c || ' of ' || n || ' country values drive 80% of quantity', 'opportunity', 'info', CAST(0.8 AS DOUBLE), NULL::VARCHAR,
  CASE WHEN c < n THEN '{fixed.BASIS["pareto"]}' END, CASE WHEN c < n THEN c || ' of ' || n || ' country values produce 80% of quantity. Give those ' || c || ' explicit coverage and decide whether the other ' || (n - c) || ' earn their cost.' END
  FROM cut WHERE n > 0),
cr AS (SELECT * FROM ({_corr.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')}) WHERE rows >= 10 ORDER BY round(abs(correlation), 12) DESC, "left", "right" LIMIT 1),
w_pairs AS (SELECT 'correlation', NULL::VARCHAR, 100001, "left" || ' and ' || "right" || ' move together (r = ' || printf('%.2f', correlation) || ')', 'finding', 'info', CAST(0.65 AS DOUBLE), NULL::VARCHAR, '{fixed.BASIS["correlation"]}',
  "left" || ' and ' || "right" || ' move together at r=' || printf('%.2f', correlation) || '. That is association, not cause: check for a common driver such as season before forecasting one from the other.'
  FROM cr WHERE abs(correlation) >= 0.5),
missing AS (SELECT * FROM ({ORACLES["role_notes"]})),
w_caveat AS (SELECT 'caveat', NULL::VARCHAR, 100012, trim(split_part(note, ':', 1)), 'quality_caveat', 'warning', CAST(1.0 AS DOUBLE), NULL::VARCHAR, '{fixed.BASIS["caveat"]}',
  note || ' Settle this at the source before the figures are used; it is reported, not repaired.' FROM missing),
worded AS ({union(f"SELECT * FROM w_{part}" for part in ("change", "trend", "anomaly", "return", "segment", "season", "pareto", "pairs", "caveat"))})"""
_shown = "rule, kpi, title, category, severity, recommendation_basis, recommendation"
ORACLES["insights_advice"] = f"{WORDS} SELECT {_shown} FROM worded"
_level = f"SELECT kpi, name, value, unit, formula FROM k JOIN formulas USING (kpi) JOIN units USING (kpi)"
ORACLES["insights_level"] = f"""{RUN}, formulas(kpi, formula) AS (VALUES {_formulas}), units(kpi, unit) AS (VALUES {_units})
SELECT 'level' AS rule, kpi, name || ' is ' || {worded("value")} || ' ' || unit AS title, name || ' was computed as ' || {worded("value")} || ' using ' || formula || '.' AS description FROM ({_level})"""


def greedy(source: str, in_all: int, per_metric: int, per_rule: int) -> str:
    """Ranking as recursion over the findings of a run: ``source`` has run_id, nth (from 1), title, metric, basis (null: none)."""
    bar = f"""f.title IN (SELECT unnest(titles)) OR len(list_filter(metrics, lambda m: m = f.metric)) >= {per_metric}
      OR (f.basis IS NOT NULL AND len(list_filter(bases, lambda b: b = f.basis)) >= {per_rule}) OR len(titles) >= {in_all}"""
    bar = bar.replace("f.title IN (SELECT unnest(titles))", "list_contains(titles, f.title)")
    return f"""picked AS (SELECT run_id, CAST(0 AS BIGINT) AS nth, CAST(NULL AS BIGINT) AS rank, []::VARCHAR[] AS titles, []::VARCHAR[] AS metrics, []::VARCHAR[] AS bases FROM (SELECT DISTINCT run_id FROM {source})
  UNION ALL SELECT run_id, nth, CASE WHEN NOT barred THEN len(titles) + 1 END, CASE WHEN barred THEN titles ELSE list_append(titles, title) END,
    CASE WHEN barred THEN metrics ELSE list_append(metrics, metric) END, CASE WHEN barred OR basis IS NULL THEN bases ELSE list_append(bases, basis) END
  FROM (SELECT f.*, titles, metrics, bases, {bar} AS barred FROM picked p JOIN {source} f ON f.run_id = p.run_id AND f.nth = p.nth + 1))"""


_weight = lambda table, of: "CASE " + of + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0.4 END"
_move = "coalesce(least(0.6, abs(TRY_CAST(nullif(regexp_extract(comparison, '([-+]?\\d+(?:\\.\\d+)?)%', 1), '') AS DOUBLE)) / 100), 0)"
ORACLES["insights_ranked"] = f"""{WORDS.replace("WITH sales", "WITH RECURSIVE sales", 1)},
sc AS (SELECT 'run-1' AS run_id, *, round({_weight(fixed.CATEGORY_WEIGHT, "category")} + {_weight(fixed.SEVERITY_WEIGHT, "severity")} + confidence * 0.5
  + CASE WHEN recommendation IS NULL THEN 0 ELSE 0.3 END + {_move}, 9) AS score FROM worded),
metric_of AS (SELECT sc.*, coalesce(kpi, CASE rule WHEN 'pareto' THEN 'quantity by country' WHEN 'correlation' THEN split_part(title, ' and ', 1) || ' ~ ' || split_part(split_part(title, ' and ', 2), ' move', 1) END) AS own FROM sc),
fs AS (SELECT run_id, row_number() OVER (ORDER BY score DESC, position, title) AS nth, lower(title) AS title, coalesce(own, '#' || (row_number() OVER (ORDER BY score DESC, position, title) - 1)) AS metric, recommendation_basis AS basis,
  rule, kpi, title AS said, score, recommendation FROM metric_of),
{greedy("fs", fixed.MAX_FINDINGS, fixed.MAX_FINDINGS_PER_METRIC, fixed.MAX_FINDINGS_PER_RULE)}
SELECT rank, rule, kpi, said AS title, score, recommendation, basis AS recommendation_basis FROM fs JOIN picked USING (run_id, nth) WHERE rank IS NOT NULL"""
ORACLES["ranking_by_run"] = f"""WITH RECURSIVE fs AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, position) AS nth, lower(title) AS title, metric, basis, position FROM (
  SELECT 'c' || o_custkey % 40 AS run_id, o_orderkey AS position, CASE WHEN o_orderkey % 2 = 0 THEN 'Finding ' ELSE 'FINDING ' END || o_orderkey % 97 AS title, 'm' || o_orderkey % 11 AS metric,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'rule ' || o_orderkey % 6 END AS basis, round(o_totalprice / 50000) AS score FROM orders)),
{greedy("fs", fixed.MAX_FINDINGS, fixed.MAX_FINDINGS_PER_METRIC, fixed.MAX_FINDINGS_PER_RULE)}
SELECT run_id, rank, position FROM fs JOIN picked USING (run_id, nth) WHERE rank IS NOT NULL"""

# --- Types and counts that need care
_BIG = "CAST(9007199254740993 AS DECIMAL(20, 0)) + o_orderkey"
ORACLES["profile_decimal"] = f"""WITH d AS (SELECT CAST({_BIG} AS DECIMAL(20, 0)) AS big_id, CAST({_BIG} - o_orderkey % 7 AS DECIMAL(20, 0)) AS near, CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS total,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 11 AS DECIMAL(38, 30)) / 1000000000 END AS fine FROM orders),
u AS ({union(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS distinct_count, count(*) AS n, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS least FROM d" for c in ("big_id", "near", "total", "fine"))})
SELECT column_name, distinct_count, null_count, distinct_count * 100.0 / n >= 99.5 AND null_count = 0 AS is_candidate_pk, least FROM u"""
_edged = "value <> trim(value, E' \\t\\n\\r')"
_texts = ("text", "source", "lang", "padded")
ORACLES["profile_long_text"] = f"""WITH d AS (SELECT text, source, lang, CASE WHEN doc_id % 3 = 0 THEN '  ' || text || ' ' WHEN doc_id % 3 = 1 THEN '' END AS padded FROM documents),
v AS ({union(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 2" for c in _texts)}),
top AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) <= 10),
low AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY value) <= 5)
SELECT column_name, count(*) AS distinct_values, CAST(coalesce(sum(n) FILTER ({_edged}), 0) AS BIGINT) AS whitespace_count, CAST(coalesce(sum(n) FILTER (value = ''), 0) AS BIGINT) AS empty_count,
  md5(min(value) FILTER ({_edged})) AS example,
  (SELECT md5(string_agg(value || ':' || n, '|' ORDER BY n DESC, value)) FROM top t WHERE t.column_name = v.column_name) AS top_values,
  (SELECT md5(string_agg(value, '|' ORDER BY value)) FROM low l WHERE l.column_name = v.column_name) AS sample_values FROM v GROUP BY 1"""
ORACLES["typed_load"] = """SELECT CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day, round(sum(o_totalprice), 2) AS total, count(*) AS rows,
'ordered=parse_datetime,priority=keep,total=cast_numeric' AS decisions FROM orders"""
ORACLES["row_limit"] = """SELECT count(*) AS rows, least(count(*), 100) AS limited, least(count(*), 20) AS sampled, count(*) AS whole FROM lineitem"""
ORACLES["spec_errors"] = """SELECT kpi, status, value FROM (VALUES ('any_case', 'computed', (SELECT count(*) FROM orders)), ('qualified', 'computed', (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))),
('unknown_column', 'invalid_formula', NULL), ('unknown_table', 'invalid_formula', NULL), ('ambiguous', 'invalid_formula', NULL), ('no_aggregate', 'invalid_formula', NULL)) t(kpi, status, value)"""
ORACLES["breakdown_fall_through"] = f"""{SALES}, s AS ({long(pick("net_revenue", "order_count"), "sales WHERE country IS NOT NULL", "country AS dimension", None)}),
e AS (SELECT event_type AS dimension, 'avg_value' AS kpi, avg(value) AS value FROM events WHERE event_type IS NOT NULL GROUP BY 1),
r AS (SELECT 'sales.country' AS dimension_name, kpi, dimension, value FROM s UNION ALL SELECT 'events.event_type', kpi, dimension, value FROM e)
SELECT kpi, dimension_name, dimension, round(value, 2) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY value DESC NULLS LAST, dimension) AS rank FROM r) WHERE rank <= 7"""
_labels = {"basket": "'c' || o_orderkey % 201", "shelf": "'d' || o_orderkey % 200", "customer_city": "'e' || o_custkey % 3", "order_day": "o_orderdate"}
ORACLES["dimensions_left_out"] = f"""WITH u AS ({union(f"SELECT '{c}' AS column_name, count(DISTINCT {e}) AS n, count(*) AS rows FROM orders" for c, e in _labels.items())})
SELECT column_name, CASE WHEN column_name <> 'order_day' AND n > 200 THEN n || ' distinct values, more than 200' END AS reason, CASE WHEN column_name = 'order_day' THEN CAST(0.9 AS DOUBLE)
  WHEN n <= 200 THEN round(0.8 - least(0.3, n / 800.0), 4) END AS confidence FROM u"""
ORACLES["csv_lines"] = """SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, 'semicolon, one line a record' AS shape FROM orders GROUP BY 1"""
