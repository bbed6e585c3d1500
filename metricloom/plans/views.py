"""Business views over the raw tables, as SQL both Spark and the checks can run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metricloom.sources.readers import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SALES = """
SELECT CASE WHEN o.o_orderkey % 10 = 0 THEN concat('C', CAST(o.o_orderkey AS {string}))
            ELSE CAST(o.o_orderkey AS {string}) END AS order_id,
       l.l_partkey AS product_id,
       CASE WHEN o.o_custkey % 11 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
       CASE WHEN o.o_orderkey % 10 = 0 THEN -l.l_quantity ELSE l.l_quantity END AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price,
       0.6e0 * (l.l_extendedprice / l.l_quantity) AS cost,
       l.l_extendedprice * l.l_discount AS discount,
       l.l_tax * l.l_extendedprice AS freight,
       o.o_orderdate AS order_ts,
       n.n_name AS country,
       c.c_mktsegment AS segment,
       o.o_orderstatus AS status
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

MESSY_ORDERS = """
SELECT o_orderkey AS order_id,
       CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN concat('  ', o_orderstatus, ' ')
            WHEN o_orderkey % 19 = 0 THEN '   ' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 23 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount,
       CASE WHEN o_orderkey % 29 = 0 THEN CAST(-2 AS INT) ELSE CAST(o_orderkey % 5 AS INT) END AS units,
       o_orderdate AS order_ts
FROM orders
"""
MESSY = f"SELECT * FROM ({MESSY_ORDERS}) a UNION ALL SELECT * FROM ({MESSY_ORDERS}) b WHERE order_id % 13 = 0"

DIM_CUSTOMER = """
SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, c_nationkey AS nation_id
FROM customer
"""
FACT_ORDERS = """
SELECT o_orderkey AS order_id,
       CASE WHEN o_custkey % 50 = 7 THEN -o_custkey ELSE o_custkey END AS customer_id,
       o_orderstatus AS status, o_totalprice AS amount
FROM orders
"""
FACT_LINES = """
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS supplier_id, l_quantity AS quantity
FROM lineitem
"""
DIM_NATION = "SELECT n_nationkey AS nation_id, n_name AS nation_name FROM nation"


def duck(sql: str) -> str:
    return sql.replace("{string}", "VARCHAR")


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{folder}/{n}.parquet") for n in names}


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run a view's SQL over the parquet tables it names."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
    text = sql.replace("{string}", "STRING")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables(spark, folder, *used))


def sales(spark: SparkSession, folder: str, keep: Callable[[DataFrame], DataFrame] = lambda joined: joined) -> DataFrame:
    """The view SALES. Its lines are joined last: they are by far the most rows and are moved once, without any other column.

    ``keep`` gets the joined columns as the tables have them, to write them for instance; what the
    view computes is computed where it is read, as products and quotients take more room than their factors.
    """
    columns, joins = SALES.split("FROM lineitem l\n")
    lines, rest = joins.split("\n", 1)
    used = ", ".join(dict.fromkeys(re.findall(r"\b[a-z]\.[a-z]_\w+", columns)))
    joined = view(spark, folder, f"SELECT {used} FROM orders o\n{rest}{lines.replace('JOIN orders o', 'JOIN lineitem l')}")
    return spark.sql(re.sub(r"\b[a-z]\.(?=[a-z]_)", "", columns).replace("{string}", "STRING") + "FROM {joined}", joined=keep(joined))
