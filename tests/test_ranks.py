"""Exact quantiles when the cuts say nothing: buckets are cut again until they are small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import ranks

PROBS = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}


@pytest.fixture
def held(spark):
    """Two keys; all values of a key in one bucket, some many times."""
    rng = np.random.default_rng(5)
    values = {"a": np.unique(rng.normal(size=4000) ** 3), "b": np.arange(2500) * 1e-9 + 1e6}
    rows = [(k, float(v), int(n), 0) for k, vs in values.items() for v, n in zip(vs, rng.integers(1, 4, len(vs)))]
    return rows, spark.createDataFrame(rows, "k string, value double, n long, _bucket int").repartition(4)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_one_bucket_of_all_values(held, monkeypatch, method):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 100)
    rows, placed = held
    got = {r["k"]: r for r in ranks.exact_quantiles(placed, ["k"], PROBS, method).collect()}
    for key in "ab":
        whole = np.sort(np.repeat([r[1] for r in rows if r[0] == key], [r[2] for r in rows if r[0] == key]))
        for name, q in PROBS.items():
            want = np.quantile(whole, q) if method == "linear" else whole[int(np.floor((len(whole) - 1) * q + 0.5))]
            assert got[key][name] == pytest.approx(want, rel=1e-15, abs=1e-15)


def test_no_task_orders_more_than_the_bound(held, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 100)
    _, placed = held
    middle = F.array(F.struct(F.lit("q").alias("name"), F.lit("low").alias("end"), F.lit(2000).cast("bigint").alias("rank"), F.lit(0.0).alias("part")))
    wanted = placed.withColumn("_size", F.lit(4000).cast("bigint")).withColumn("_wanted", middle)
    found = ranks.narrowed(wanted, ["k"])
    sizes = [r["count"] for r in found.groupBy("k", "_bucket").count().collect()]
    assert len(sizes) == 2 and max(sizes) <= 100


def test_equal_doubles_stay_together(spark, monkeypatch):
    """What no cut tells apart ends the search and not the run."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 3)
    rows = spark.createDataFrame([(float(2**60), 1, 0)] * 10, "value double, n long, _bucket int")
    assert ranks.exact_quantiles(rows.withColumn("k", F.lit(1)), ["k"], {"q": 0.5}).first()["q"] == 2.0**60
