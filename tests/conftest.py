import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from metricloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def retail(spark):
    """Twelve months of four lines each, and one cancellation."""
    from datetime import datetime

    rows = [
        (f"{5000 + m * 2 + i // 2}", f"P{i}", f"thing {i}", 2 + i, datetime(2020, m + 1, 3 + i, 10), 5.0 + i, 100 + i % 3,
         ["France", "Spain"][i % 2])
        for m in range(12) for i in range(4)
    ] + [("C999", "P1", "thing 1", -5, datetime(2020, 6, 15), 6.0, 101, "Spain")]
    schema = ("InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate timestamp_ntz, "
              "UnitPrice double, CustomerID int, Country string")
    return spark.createDataFrame(rows, schema)
