"""Word lists, thresholds, patterns and formats.

Everything here is a value that has to be exactly what it is for results to
agree with what users of such reports already have. No logic lives in this file.
"""

# --- Fixed values: text edges. Code points with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0          "
    "      　"
)

# --- Fixed values: candidate date formats, in order of preference.
DATE_FORMATS = [
    "%Y-%m-%d %H:%M:%S%.f",
    "%Y-%m-%dT%H:%M:%S%.f",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%dT%H:%M",
    "%Y-%m-%d",
    "%Y/%m/%d %H:%M:%S",
    "%Y/%m/%d",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M",
    "%d/%m/%Y %H:%M",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%m/%d/%y %H:%M",
    "%d/%m/%y %H:%M",
    "%m/%d/%y",
    "%d/%m/%y",
    "%m-%d-%Y %H:%M",
    "%d-%m-%Y %H:%M",
    "%m-%d-%Y",
    "%d-%m-%Y",
    "%d-%b-%Y",
    "%d %b %Y",
    "%b %d, %Y",
    "%d.%m.%Y %H:%M",
    "%d.%m.%Y",
]

# --- Fixed values: type inference thresholds, shapes and key-like names.
MIN_DATE_RATE = 0.95
MIN_NUMBER_RATE = 1.0
SHAPE_SHARE = 0.8
KEPT_RUNNERS_UP = 5
DATE_SHAPE = r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ T].*)?$|^\s*\d{1,2}[ -][A-Za-z]{3}"
NUMBER_SHAPE = r"^\s*[-+]?[\d\s,.']*\d([eE][-+]?\d+)?\s*$"
DATE_PARTS = r"^\s*(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})"
SEPARATORS = r"[\s,']"
LEADING_ZERO = r"^\s*0\d"
KEY_NAME_HINTS = (
    "id", "uuid", "guid", "key", "code", "ref", "sku", "isbn", "zip", "postal",
    "cep", "phone", "invoice", "account", "barcode",
)
KEY_NAME_TOKENS = ("no", "nr", "num")

# --- Fixed values: logical type hints found in column names.
ID_HINTS = ("id", "uuid", "pk", "key", "code")
DATE_HINTS = ("date", "time", "timestamp", "dt", "created", "updated")
MONEY_HINTS = ("price", "amount", "value", "revenue", "cost", "payment", "total", "fee", "freight")
GEO_HINTS = ("city", "state", "country", "zip", "cep", "lat", "lon", "lng", "region", "province")
QTY_HINTS = ("qty", "quantity", "count", "units")

# --- Fixed values: personal data patterns and names.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^\+?[\d\s().-]{8,20}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NAME_HINTS = ("name", "first_name", "last_name", "full_name", "customer_name")
ADDRESS_HINTS = ("address", "street", "zip", "cep", "postcode", "city")
NATIONAL_ID_HINTS = ("cpf", "ssn", "passport")

# --- Fixed values: business roles (role, kind, name patterns, logical types, names ruled out).
KEY_TYPES = ("identifier", "categorical", "text", "numeric")
MONEY_TYPES = ("currency", "numeric")
LABEL_TYPES = ("categorical", "text")
ROLES = [
    ("order_id", "identifier", ["invoice", "order", "transaction", "receipt", "basket", "ticket"],
     KEY_TYPES, ["date", "time", "item", "line", "detail", "status"]),
    ("customer_id", "identifier", ["customer", "client", "buyer", "user", "account", "member"],
     KEY_TYPES, ["date", "name", "city", "state", "country", "segment", "type"]),
    ("product_id", "identifier", ["product", "item", "sku", "stock", "article", "material"],
     KEY_TYPES, ["date", "categ", "name", "desc", "weight", "qty", "quantity"]),
    ("quantity", "measure", ["quantity", r"\bqty\b", r"units?\b", "volume", r"count\b", "pieces"],
     ("quantity", "numeric", "currency"), ["price", "amount", "total", "id$", "code"]),
    ("unit_price", "measure", ["unit[_ ]?price", "^price$", "price", "rate", "tarif"],
     MONEY_TYPES, ["total", "amount", "sum", "discount", "qty", "quantity"]),
    ("amount", "measure", ["amount", "revenue", "total", "sales", "turnover", "payment", "value", "gmv"],
     MONEY_TYPES, ["id$", "code", "count", "qty", "unit[_ ]?price"]),
    ("cost", "measure", ["cost", "cogs", "expense", "purchase[_ ]?price"], MONEY_TYPES, ["id$"]),
    ("discount", "measure", ["discount", "rebate", "promo"], MONEY_TYPES, ["id$", "flag"]),
    ("freight", "measure", ["freight", "shipping", "delivery[_ ]?(cost|fee|price)"],
     MONEY_TYPES, ["date", "id$"]),
    ("event_date", "dimension", ["date", "time", "timestamp", "created", "ordered", "purchase"],
     ("datetime",), ["deliver", "ship", "approv", "estimat"]),
    ("geo", "dimension", ["country", "region", "state", "city", "province", "zone", "market"],
     ("geo", "categorical", "text"), ["code$", "id$", "zip", "postal"]),
    ("category", "dimension", ["categ", "segment", "type", "class", "family", "group", "department"],
     LABEL_TYPES, ["id$", "date"]),
    ("status", "dimension", ["status", "state$", "stage", "phase"], LABEL_TYPES, ["id$", "date"]),
    ("channel", "dimension", ["channel", "source", "medium", "platform", "store"],
     LABEL_TYPES, ["id$", "date"]),
    ("description", "dimension", ["desc", "name", "label", "title"],
     ("text", "categorical"), ["id$"]),
]
ROLE_ORDER = [
    "quantity", "unit_price", "cost", "discount", "freight", "amount", "order_id", "customer_id",
    "product_id", "event_date", "geo", "category", "status", "channel", "description",
]
EXPECTED_ROLES = ("quantity", "unit_price", "amount", "order_id", "event_date")
MAX_AXIS_VALUES = 200

# --- Fixed values: business domains and the terms that point at them, in library order.
DOMAIN_TERMS = {
    "general": ["performance", "volume", "quality", "count", "total", "average",
                "date", "category", "status"],
    "ecommerce": ["order", "customer", "product", "payment", "delivery", "revenue",
                  "revenue", "orders", "customers", "quantity", "delivery_days",
                  "order_date", "customer", "product", "category", "region", "payment_type"],
    "retail": ["sku", "store", "basket"],
    "telecommunications": ["churn", "arpu"],
    "banking": ["balance", "transaction"],
    "finance": ["pnl", "exposure"],
    "transport": ["route", "delay"],
    "tourism": ["booking", "occupancy"],
    "health": ["encounter", "claim"],
    "public_services": ["case", "citizen"],
    "energy": ["consumption", "meter"],
    "marketing": ["campaign", "conversion"],
}

# --- Fixed values: join discovery.
MIN_NAME_AFFINITY = 0.35
MIN_OVERLAP_KEPT = 0.2
MIN_OVERLAP_VALID = 0.6
UNIQUE_SIDE = 0.95

# --- Fixed values: findings, their weights and caps.
MATERIAL_MOVE = 0.15
CONCENTRATION_FLOOR = 0.4
CATEGORY_WEIGHT = {"risk": 1.0, "anomaly": 0.9, "opportunity": 0.8, "trend": 0.6,
                   "quality_caveat": 0.55, "finding": 0.4}
SEVERITY_WEIGHT = {"critical": 1.0, "warning": 0.75, "info": 0.4}
MAX_FINDINGS = 24
MAX_FINDINGS_PER_METRIC = 3
MAX_FINDINGS_PER_RULE = 2
MIN_QUALITY = 55.0
MIN_KPI_RATIO = 0.6

# --- Fixed values: names of the recommendation rules.
BASIS = {
    "concentration": "concentration>=40% of an additive metric",
    "adverse": "period-over-period move >= 15%, unfavourable",
    "favourable": "period-over-period move >= 15%, favourable",
    "pareto": "pareto 80% cutoff",
    "correlation": "|pearson r| >= 0.5",
    "seasonality": "peak/trough spread >= 50%",
    "return_rate": "order return rate >= 5%",
    "caveat": "data quality caveat",
}
