import math

import numpy as np
import pytest

from metricloom.operators import numbers, profile

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def brute(values):
    known = [v for v in values if v is not None]
    plain = sorted(v for v in known if v == v)
    distinct = set(plain) | ({"nan"} if any(v != v for v in known) else set())
    rank = lambda q: int(math.floor((len(plain) - 1) * q + 0.5))
    return len(distinct), {k: float(plain[rank(q)]) if plain else None for k, q in QUARTILES.items()}


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_parts_and_blocks_do_not_change_results(spark, monkeypatch, block):
    """Small parts and blocks: every value crosses the exchange, hot ones from each block."""
    for name, size in (("PART_ROWS", 300), ("SAMPLED", 500), ("BLOCK", block)):
        monkeypatch.setattr(numbers, name, size)
    rng = np.random.default_rng(5)
    odd = [0.0, -0.0, float("nan"), float("inf"), float("-inf"), None, 1e-300, -1e300]
    rows = [(int(rng.integers(-2**62, 2**62)) if i % 3 else 2**53 + i, float(rng.normal()) if i % 2 else odd[i // 2 % len(odd)],
             i % 3 if i % 5 else None, None, float("nan")) for i in range(4000)]
    df = spark.createDataFrame(rows, "`a.b` bigint, x double, few bigint, none bigint, nan double").repartition(5)
    got = numbers.summarise(df, len(rows), 5, QUARTILES, ["a.b", "x", "few", "none", "nan"])
    for i, name in enumerate(df.columns):
        distinct, quartiles = brute([r[i] for r in rows])
        assert got[name]["distinct"] == distinct
        assert {q: got[name][q] for q in QUARTILES} == quartiles
    assert got["a.b"]["least"] == sorted({r[0] for r in rows})[:5]
    assert got["x"]["least"][:2] == [float("-inf"), -1e300]
    assert got["few"]["least"] == [0, 1, 2] and got["none"]["least"] == [] and math.isnan(got["nan"]["least"][0])


def test_values_are_not_moved_in_long_form(spark, monkeypatch):
    """Whole and floating columns are never unpivoted into a row per value."""
    monkeypatch.setattr(profile, "_long", lambda *a: pytest.fail("a row per value"))
    df = spark.createDataFrame([(i, i / 7, -0.0 if i % 2 else 0.0) for i in range(500)], "k bigint, x double, z double")
    got = {r["column_name"]: r for r in profile.profile_columns(df, "t").collect()}
    assert (got["k"]["distinct_count"], got["x"]["distinct_count"], got["z"]["distinct_count"]) == (500, 500, 1)
    assert got["z"]["sample_values"] == ["0.0"] and got["k"]["sample_values"] == ["0", "1", "2", "3", "4"]
