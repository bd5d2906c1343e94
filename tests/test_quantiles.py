import random

import pytest
from pyspark.sql import functions as F

from evidex.operators.quantiles import exact_percentiles

WANTED = {"least": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "most": 1.0}


def values(seed):
    rng = random.Random(seed)
    shapes = {"even": lambda: rng.random(), "steep": lambda: 2.0 ** rng.uniform(-900, 900), "ties": lambda: float(rng.choice([1, 1, 1, 2, 3])), "edge": lambda: 5.0 if rng.random() < 0.5 else rng.uniform(0, 5), "signs": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(9), None: lambda: float(rng.randrange(100))}
    rows = [(name, draw() if rng.random() > 0.05 else None) for name, draw in shapes.items() for _ in range(rng.randrange(300, 3000))]
    return rows + [("one", 7.0), ("two", 1.0), ("two", 2.0), ("nulls", None), ("big", float("inf")), ("big", float("-inf")), ("big", 0.0)]


@pytest.mark.parametrize(("seed", "small"), [(1, 10_000), (2, 7), (3, 1)])
def test_percentiles_equal_sparks_own(spark, seed, small):
    df = spark.createDataFrame(values(seed), "k string, v double").repartition(5)
    want = {r.k: tuple(r)[1:] for r in df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in WANTED.items()]).collect()}
    got = {r.k: tuple(r)[1:] for r in exact_percentiles(df, ["k"], "v", WANTED, small=small).collect()}
    assert got.keys() == want.keys() and "nulls" not in got
    for k, mine in got.items():
        assert mine == pytest.approx(want[k], rel=1e-12), k


def test_values_of_the_contract(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (10, 20, 30, 40)], "k int, v double")
    assert tuple(exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()[0]) == (1, 25.0, 38.5)
    assert exact_percentiles(df.limit(0), ["k"], "v", {"p50": 0.5}).collect() == []


def test_integers_and_two_keys(spark):
    df = spark.createDataFrame([(i % 3, "x" if i % 2 else None, i) for i in range(999)], "a int, b string, v int")
    want = {(r.a, r.b): r.p for r in df.groupBy("a", "b").agg(F.percentile("v", F.lit(0.3)).alias("p")).collect()}
    assert {(r.a, r.b): r.p for r in exact_percentiles(df, ["a", "b"], "v", {"p": 0.3}, small=4).collect()} == pytest.approx(want)
