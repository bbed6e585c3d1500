"""The KPI catalogue: declared over business roles, instantiated for the roles a dataset binds."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from metricloom.operators.measures import Measure
from metricloom.operators.roles import Binding

PLAIN = re.compile("[A-Za-z_][A-Za-z0-9_]*")

CATALOGUE = """slug string, name string, description string, business_meaning string, formula string, unit string,
confidence double, priority int, higher_is_better boolean, additivity string, tables array<string>,
dimensions array<string>, source string, roles map<string,string>, revenue_basis string, filters array<string>"""


@dataclass(frozen=True)
class KpiSpec:
    slug: str
    name: str
    measure: Measure
    unit: str
    tables: tuple[str, ...]
    description: str = ""
    business_meaning: str = ""
    confidence: float = 0.95
    priority: int = 50
    higher_is_better: bool | None = True
    dimensions: tuple[str, ...] = ()
    source: str = "catalog"
    roles: dict[str, str] = field(default_factory=dict)
    revenue_basis: str | None = None
    filters: tuple[str, ...] = ()


def reference(table: str, column: str) -> str:
    """A column in SQL text, whatever characters its names have."""
    return ".".join("`" + part.replace("`", "``") + "`" if not PLAIN.fullmatch(part) else part for part in (table, column))


def quoted(full: str) -> str:
    """``table.column`` as a reference; the first dot ends the table's name."""
    return reference(*full.split(".", 1))


class Terms:
    """The building blocks of the KPIs under one binding; ``None`` where roles are missing."""

    def __init__(self, binding: Binding):
        self.binding, self.used_filters, self.used_roles, self.used_tables = binding, [], [], []

    def role(self, name: str) -> str:
        self.used_roles.append(name)
        return quoted(self.binding.roles[name])

    @property
    def revenue_basis(self) -> tuple[str, str] | None:
        """Quantity times price where both are bound, else a line amount."""
        b = self.binding.roles
        if self.binding.has("quantity", "unit_price"):
            product = f"{quoted(b['quantity'])} * {quoted(b['unit_price'])}"
            return product, f"quantity times unit price, summed per line ({product})"
        if self.binding.has("amount"):
            return quoted(b["amount"]), f"a line amount ({quoted(b['amount'])})"
        return None

    def revenue(self, where: str | None = None) -> Measure:
        self.used_tables += ["quantity", "unit_price"] if self.binding.has("quantity", "unit_price") else ["amount"]
        return Measure.sum(self.revenue_basis[0], where)

    def cancelled(self, yes: bool) -> str | None:
        """Rows of cancelled orders (or of the others): by id prefix, else by sign of quantity."""
        b = self.binding
        if b.cancel_prefix and b.has("order_id"):
            text = f"{quoted(b.roles['order_id'])} {'LIKE' if yes else 'NOT LIKE'} '{b.cancel_prefix}%'"
            self.used_tables.append("order_id")
        elif b.has_negative_quantity and b.has("quantity"):
            text = f"{quoted(b.roles['quantity'])} {'<' if yes else '>='} 0"
            self.used_tables.append("quantity")
        else:
            return None
        self.used_filters.append(text)
        return text

    def kept(self) -> str | None:
        return self.cancelled(False)

    def orders(self, where: str | None = None) -> Measure:
        return Measure.count_distinct(self.role("order_id"), where)

    def units(self) -> Measure:
        quantity = self.role("quantity")
        return Measure.sum(quantity, f"{quantity} > 0")

    def returned(self) -> str:
        text = f"{quoted(self.binding.roles['quantity'])} < 0"
        self.used_tables.append("quantity")
        self.used_filters.append(text)
        return text


@dataclass(frozen=True)
class Template:
    slug: str
    name: str
    unit: str
    priority: int
    build: Callable[[Terms], Measure]
    description: str
    business_meaning: str
    needs: tuple[str, ...] = ()
    revenue: bool = False
    domains: tuple[str, ...] = ()  # empty: every domain
    needs_returns: bool = False
    needs_cancellations: bool = False
    higher_is_better: bool = True
    confidence: float = 0.95
    name_with_returns: str | None = None


SHOPS = ("ecommerce", "retail")
# Slugs, names, units, priorities, domains and gates of the KPIs.
TEMPLATES = [
    Template("net_revenue", "Revenue", "currency", 1, lambda t: t.revenue(),
             "Value of all lines.", "The top line, summed line by line; return lines deduct themselves.",
             revenue=True, domains=(*SHOPS, "general"), name_with_returns="Net Revenue"),
    Template("gross_revenue", "Gross Revenue", "currency", 2, lambda t: t.revenue(t.kept()),
             "Value of lines on orders that were not cancelled.", "What was sold before anything came back.",
             revenue=True, domains=SHOPS, needs_cancellations=True),
    Template("returned_value", "Returned Value", "currency", 6, lambda t: t.revenue(t.returned()),
             "Value of lines with a negative quantity.", "What returns cost.",
             needs=("quantity", "unit_price"), revenue=True, domains=SHOPS, needs_returns=True,
             higher_is_better=False),
    Template("order_count", "Orders", "count", 3, lambda t: t.orders(t.kept()),
             "Distinct orders, without cancelled ones where they are marked.", "How many orders there were.",
             needs=("order_id",)),
    Template("cancelled_orders", "Cancelled Orders", "count", 6, lambda t: t.orders(t.cancelled(True)),
             "Distinct cancelled orders.", "How many orders were taken back.",
             needs=("order_id",), domains=SHOPS, needs_cancellations=True, higher_is_better=False),
    Template("unique_customers", "Unique Customers", "count", 4,
             lambda t: Measure.count_distinct(t.role("customer_id")),
             "Distinct customers.", "Size of the active customer base.", needs=("customer_id",)),
    Template("average_order_value", "Average Order Value", "currency", 5,
             lambda t: t.revenue(t.kept()) / t.orders(t.kept()),
             "Revenue per distinct order.", "What a typical order is worth; cancelled orders count on neither side.",
             needs=("order_id",), revenue=True),
    Template("revenue_per_customer", "Revenue per Customer", "currency", 7,
             lambda t: t.revenue() / Measure.count_distinct(t.role("customer_id")),
             "Revenue per distinct customer.", "What a customer is worth on average.",
             needs=("customer_id",), revenue=True),
    Template("units_sold", "Units Sold", "units", 8, lambda t: t.units(),
             "Quantity on lines that are not returns.", "Volume moved.", needs=("quantity",)),
    Template("units_per_order", "Units per Order", "units", 9, lambda t: t.units() / t.orders(),
             "Units sold per distinct order.", "Basket size by volume.", needs=("quantity", "order_id")),
    Template("order_return_rate", "Order Return Rate", "percent", 10,
             lambda t: t.orders(t.cancelled(True)) / t.orders() * 100,
             "Share of orders that are cancelled.", "A quality signal that can hide behind healthy sales.",
             needs=("order_id",), domains=SHOPS, needs_cancellations=True, higher_is_better=False),
    Template("active_products", "Active Products", "count", 11,
             lambda t: Measure.count_distinct(t.role("product_id")),
             "Distinct products sold.", "Breadth of the range that moves.", needs=("product_id",)),
    Template("average_unit_price", "Average Unit Price", "currency", 12,
             lambda t: Measure.avg(t.role("unit_price")),
             "Mean price over lines.", "Price level; read it next to units sold.", needs=("unit_price",)),
    Template("gross_margin", "Gross Margin", "currency", 13,
             lambda t: t.revenue() - Measure.sum(f"{t.role('quantity')} * {t.role('cost')}"),
             "Revenue less the cost of what was sold.", "What is left after the goods are paid for.",
             needs=("quantity", "cost"), revenue=True, domains=(*SHOPS, "general")),
    Template("transaction_lines", "Transaction Lines", "count", 40, lambda t: Measure.count(),
             "Rows of the fact table.", "Volume of records.", confidence=0.9),
    Template("freight_cost", "Freight Cost", "currency", 14, lambda t: Measure.sum(t.role("freight")),
             "Total shipping cost.", "Logistics spend.",
             needs=("freight",), domains=(*SHOPS, "transport"), higher_is_better=False),
    Template("discount_given", "Discount Given", "currency", 15, lambda t: Measure.sum(t.role("discount")),
             "Total discount.", "What promotions cost.",
             needs=("discount",), domains=(*SHOPS, "marketing"), higher_is_better=False),
]


def fact_table(binding: Binding) -> str | None:
    """The table a bare row count is taken over: where the lines or orders are."""
    for role in ("quantity", "amount", "order_id", "event_date"):
        if binding.has(role):
            return binding.roles[role].split(".", 1)[0]
    refs = list(binding.roles.values()) + [d for d, _ in binding.dimensions]
    return refs[0].split(".", 1)[0] if refs else None


def instantiate(binding: Binding, domain: str, labels_shown: int | None = None) -> list[KpiSpec]:
    """Every KPI the bound roles support, by priority; it lists all label dimensions, or the first few."""
    time = [d for d, kind in binding.dimensions if kind == "datetime"][:1]
    labels = [d for d, kind in binding.dimensions if kind != "datetime"][:labels_shown]
    specs = []
    for template in TEMPLATES:
        terms = Terms(binding)
        if template.domains and domain not in template.domains:
            continue
        if not binding.has(*template.needs) or (template.revenue and terms.revenue_basis is None):
            continue
        if template.needs_returns and not binding.returns:
            continue
        if template.needs_cancellations and terms.cancelled(True) is None:
            continue
        terms.used_filters.clear(), terms.used_tables.clear()
        measure = template.build(terms)
        refs = [binding.roles[r] for r in {*terms.used_roles, *terms.used_tables}]
        tables = tuple(sorted({r.split(".", 1)[0] for r in refs})) or tuple(filter(None, [fact_table(binding)]))
        if not tables:
            continue
        named = template.name_with_returns if binding.returns and template.name_with_returns else template.name
        shown = {*terms.used_roles, "quantity", "unit_price", "amount"}
        specs.append(KpiSpec(
            template.slug, named, measure, template.unit, tables, template.description, template.business_meaning,
            template.confidence, template.priority, template.higher_is_better, tuple(time + labels),
            roles={r: ref for r, ref in binding.roles.items() if r in shown},
            revenue_basis=terms.revenue_basis[1] if template.revenue else None,
            filters=tuple(sorted(set(terms.used_filters))),
        ))
    return sorted(specs, key=lambda s: s.priority)


def fallback(
    measures: Sequence[tuple[str, str, str, str | None]], identifiers: Sequence[str],
    keep_measures: int | None = None, keep_identifiers: int | None = None,
) -> list[KpiSpec]:
    """Plain sums, averages and distinct counts for a dataset no role matched, of all columns or the first few.

    ``measures`` are ``(table, column, aggregation, unit)``; ``identifiers`` are ``table.column``.
    """
    plain = {"SUM": (Measure.sum, "Total"), "AVG": (Measure.avg, "Mean")}
    out = []
    for place, (table, column, kind, unit) in enumerate(measures[:keep_measures]):
        measure, word = plain[kind]
        where = reference(table, column)
        out.append(KpiSpec(
            slug=f"{kind}_{column}".lower(), name=f"{kind.title()} of {column}", measure=measure(where), unit=unit or "units", tables=(table,),
            description=f"{word} of the column {column} in {table}.", business_meaning="A plain figure: the column has no known business role.",
            confidence=0.5, priority=60 + place, source="fallback"))
    for place, full in enumerate(identifiers[:keep_identifiers]):
        table, _, column = full.partition(".")
        out.append(KpiSpec(
            slug=f"distinct_{column}".lower(), name=f"Distinct {column}", measure=Measure.count_distinct(reference(table, column)), unit="count",
            tables=(table,), description=f"How many different {column} there are in {table}.", business_meaning="Size of an entity set, role unknown.",
            confidence=0.6, priority=70 + place, source="fallback"))
    return out


def catalogue_frame(spark: SparkSession, specs: Sequence[KpiSpec]) -> DataFrame:
    rows = [
        (s.slug, s.name, s.description, s.business_meaning, s.measure.text, s.unit, s.confidence, s.priority,
         s.higher_is_better, s.measure.additivity, list(s.tables), list(s.dimensions), s.source, s.roles,
         s.revenue_basis, list(s.filters))
        for s in specs
    ]
    return spark.createDataFrame(rows, CATALOGUE)
