import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import quantiles as Q

SHARES = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


def columns(seed):
    r = random.Random(seed)
    return {
        "normal": [r.gauss(0, 1) for _ in range(3000)],
        "wide": [math.copysign(10 ** r.uniform(-320, 308), r.random() - 0.5) for _ in range(3000)],
        "whole": [float(r.randrange(-5, 6)) for _ in range(3000)],
        "one": [7.5] * 3000,
        "ends": [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, 1.0],
        "close": [1 + i * 2.0**-52 for i in range(1200)] + [2.0] * 700,
        "single": [3.0],
        "large": [float(2**53 - r.randrange(3000)) for _ in range(2000)],
    }


@pytest.mark.parametrize(("seed", "few", "parts"), [(1, 2000, 256), (2, 3, 4), (3, 1, 256)])
def test_against_sorting(spark, monkeypatch, seed, few, parts):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "PARTS", parts)
    data = columns(seed)
    rows = [(c, v) for c, own in data.items() for v in own]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "column string, value double")
    wanted = lambda c, n: [0, n // 2, n - 1, n // 3]
    got = Q.order_statistics(df, wanted)
    assert set(got) == set(data)
    for c, own in data.items():
        own = sorted(own)
        assert got[c] == {k: own[k] for k in wanted(c, len(own))}
    found = Q.quantiles(df.where("column <> 'ends'"), SHARES)
    for c, own in data.items():
        if c != "ends":
            assert np.allclose(found[c], np.quantile(own, SHARES), rtol=1e-12, atol=1e-300), c


def test_the_power_never_falls(spark):
    values = sorted([v for own in columns(5).values() for v in own] + [2.0**k for k in range(-1074, 1024)] + [np.nextafter(2.0**k, 0) for k in range(-1000, 1024)])
    powers = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, value double").orderBy("i").select(Q.power_of_two(F.col("value"))).collect()]
    assert powers == sorted(powers)


def test_empty(spark):
    assert Q.quantiles(spark.createDataFrame([], "column string, value double"), [0.5]) == {}


def test_ten_million_distinct_values(spark):
    n = 10_000_000
    # a permutation of 0 to n - 1
    df = spark.range(n, numPartitions=8).select(F.lit("x").alias("column"), ((F.col("id") * 7_368_787) % n).cast("double").alias("value"))
    assert Q.quantiles(df, [0.1, 0.5, 0.999]) == {"x": pytest.approx([(n - 1) * s for s in (0.1, 0.5, 0.999)], rel=1e-12)}
