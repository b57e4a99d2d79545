import random

import pytest
from pyspark.sql import functions as F

from surgeline.operators.ranks import percentile_nearest, select_ranks

QUANTILES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def nearest(values, q):
    ordered = sorted(values)
    return ordered[round(q * (len(ordered) - 1))]


def groups():
    rng = random.Random(1)
    return {
        "spread": [rng.lognormvariate(0, 4) for _ in range(3000)],
        "narrow": [1000 + rng.random() * 1e-6 for _ in range(3000)],
        "negative": [rng.uniform(-5, 5) for _ in range(999)],
        "zeros": [0.0] * 700 + [1.5] * 3,
        "one value": [7.25] * 50,
        "outlier": [1.0 + rng.random() * 1e-9 for _ in range(2000)] + [1.002, 9e9],
        "single": [3.0],
        "two": [2.0, 1.0],
        "powers": [2.0**n for n in range(-300, 300)],
        "hot": [rng.choice([1.0, 1.0, 1.0, rng.random()]) for _ in range(20000)],
    }


@pytest.mark.parametrize("small", [4, 20_000])
def test_exact_for_any_distribution(spark, small):
    data = groups()
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    found = {r.k: r for r in percentile_nearest(df, ["k"], "v", QUANTILES, small).collect()}
    assert found.keys() == data.keys()
    for key, values in data.items():
        assert found[key].n == len(values)
        for name, q in QUANTILES.items():
            assert found[key][name] == nearest(values, q), (key, name)


@pytest.mark.parametrize("n", range(1, 12))
def test_bankers_rounding(spark, n):
    df = spark.range(n).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("v"))
    row = percentile_nearest(df, ["k"], "v", {"a": 0.5, "b": 0.75, "c": 0.9}).first()
    assert [row.a, row.b, row.c] == [nearest(range(n), q) for q in (0.5, 0.75, 0.9)]


def test_nulls_are_no_values(spark):
    df = spark.createDataFrame([("x", None), ("x", 2.0), ("y", None)], "k string, v double")
    rows = select_ranks(df, ["k"], "v", {"first": lambda n: F.lit(0)}).collect()
    assert [(r.k, r.n, r["first"]) for r in rows] == [("x", 1, 2.0)]


def test_no_task_orders_more_than_a_small_bin(spark):
    """One value far off, the rest as close as numbers get: bins are split again until they are small."""
    values = [1.0 + n * 2.0**-50 for n in range(6000)] + [1.0025, 1e12]
    df = spark.createDataFrame([("x", v) for v in values], "k string, v double").repartition(4).cache()
    result = percentile_nearest(df, ["k"], "v", {"p50": 0.5}, 100)
    assert result.first().p50 == nearest(values, 0.5)
    bins = [line for line in result._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in line or "Scan parquet" in line]
    assert bins  # the last step reads written bins, each of at most 100 values
