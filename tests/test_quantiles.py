import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricloom.operators.quantiles import exact_quantiles

PS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def run(spark, groups, few=True):
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    out = exact_quantiles(df, ["g"], F.col("v"), PS, few_groups=few)
    return {r["g"]: (r["value_count"], r["quantiles"]) for r in out.collect()}


def check(spark, groups, few=True):
    got = run(spark, groups, few)
    for g, values in groups.items():
        kept = [v for v in values if v is not None and np.isfinite(v)]
        if not kept:
            assert g not in got
            continue
        n, q = got[g]
        assert n == len(kept)
        assert q == pytest.approx(list(np.quantile(kept, PS)), rel=1e-12, abs=1e-12), g


def test_many_shapes(spark):
    rng = random.Random(7)
    check(
        spark,
        {
            "normal": [rng.gauss(0, 1) for _ in range(2001)],
            "constant": [3.5] * 500,
            "hot": [1.0] * 900 + [rng.random() for _ in range(100)],
            "signs": [-(10.0**k) for k in range(-20, 20)] + [10.0**k for k in range(-20, 20)] + [0.0],
            "tight": [1e9 + k * 1e-6 for k in range(300)],
            "single": [42.0],
            "pair": [1.0, 2.0],
            "holes": [None, float("nan"), float("inf"), 1.0, 4.0],
            "nothing": [None],
            "huge": [1e308, -1e308, 5e-324, 0.0],
        },
    )


def test_shuffled_join(spark):
    rng = random.Random(3)
    check(spark, {str(g): [rng.expovariate(1) for _ in range(60)] for g in range(20)}, few=False)


def test_null_group_and_no_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    rows = exact_quantiles(df, ["g"], F.col("v"), [0.5]).collect()
    assert {r["g"]: r["quantiles"][0] for r in rows} == {None: 2.0, "a": 5.0}
    assert exact_quantiles(df, [], F.col("v"), [0.5]).first()["quantiles"] == [3.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=40))
def test_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, [], F.col("v"), [0.0, 0.5, 1.0], few_groups=True).first()["quantiles"]
    ordered = sorted(values)
    n = len(ordered)
    assert got[0] == ordered[0] and got[2] == ordered[-1]
    if n % 2:
        assert got[1] == ordered[n // 2]


def test_weights(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([-1.0, 1.0]) * rng.expovariate(1), rng.randint(1, 9)) for g in "ab" for _ in range(200)]
    rows += [("a", 0.25, 100_000), ("b", None, 7)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(3)
    for few in (True, None):
        got = exact_quantiles(df, ["g"], F.col("v"), PS, few_groups=few, weight=F.col("w")).collect()
        for r in got:
            values = [v for g, v, w in rows if g == r["g"] and v is not None for _ in range(w)]
            assert r["value_count"] == len(values)
            assert r["quantiles"] == pytest.approx(list(np.quantile(values, PS)), rel=1e-12)
