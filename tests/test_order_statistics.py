import math
import random

import pytest
from pyspark.sql import functions as F

from labelwright.operators import order_statistics


def plain(values, fraction):
    own = sorted(values)
    at = (len(own) - 1) * fraction
    low, high = own[math.floor(at)], own[math.ceil(at)]
    return low if low == high else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))


@pytest.mark.parametrize("small,buckets,broadcast", [(10_000, 1024, 1 << 20), (5, 4, 1 << 20), (1, 16, 0)])
def test_quantiles_are_a_sort_s(spark, monkeypatch, small, buckets, broadcast):
    monkeypatch.setattr(order_statistics, "SMALL", small)
    monkeypatch.setattr(order_statistics, "BUCKETS", buckets)
    monkeypatch.setattr(order_statistics, "BROADCAST", broadcast)
    rng = random.Random(small)
    groups = {
        "even": [rng.random() for _ in range(300)], "odd": [rng.gauss(0, 1e9) for _ in range(201)], "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(150)], "one": [7.0], "two": [1.0, 2.0],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(120)], "edges": [-math.inf, math.inf, 0.0, order_statistics.EDGE, -0.0], "same": [4.5] * 99, None: [3.0, 1.0, 2.0, 10.0],
    }
    rows = [(k, v) for k, own in groups.items() for v in own] + [("none", None), ("none", math.nan), ("even", None), ("odd", math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").withColumn("rank", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    fractions = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.k: r for r in order_statistics.quantiles(df, "v", fractions, "k").collect()}
    assert got.keys() == groups.keys() | {"none"}
    assert got["none"].n == 0 and got["none"].quantiles is None
    for k, own in groups.items():
        own = [max(min(v, order_statistics.EDGE), -order_statistics.EDGE) for v in own]
        assert got[k].n == len(own) and (got[k].least, got[k].most) == (min(own), max(own))
        assert got[k].quantiles == [plain(own, f) for f in fractions]


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert order_statistics.quantiles(empty, "v", (0.5,), "k").count() == 0
    assert order_statistics.quantiles(empty, "v", (0.5,)).first().n == 0
