import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import features, models, moments


def frame(spark, n=400):
    r = np.random.default_rng(5)
    a, b, c = r.normal(2020, 3, n), r.normal(size=n) * 1e4 + 1e6, r.normal(size=n)
    y = 3 * c + 0.5 * (a - 2020) * c + r.normal(size=n) * 0.3 + 700
    rows = [(float(p) if i % 50 else None, float(q), float(s), float(t)) for i, (p, q, s, t) in enumerate(zip(a, b, c, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").fillna(2020.0)


def test_equals_fitting_each_fold(spark):
    df = frame(spark)
    loop = models.cross_validate(df, ["a", "b", "c"], "y", models.ridge(2.0), ["r2", "rmse"], 4, 9)
    once = moments.ridge_cv(models.with_folds(df, 4, 9), ["a", "b", "c"], "y", "_fold", 4, 2.0)
    for m in ("r2", "rmse"):
        assert once[m] == pytest.approx(loop[m], rel=1e-7)


def test_discovery_equals_the_loop(spark):
    df = frame(spark)
    plain = lambda d, f, y: models.ridge()(d, f, y)  # noqa: E731  without the mark: every candidate is fitted
    want = features.discover_interactions(df, ["a", "c"], "y", plain, "r2", ["a", "c"], least_lift=-9.0)
    got = features.discover_interactions(df, ["a", "c"], "y", models.ridge(), "r2", ["a", "c"], least_lift=-9.0)
    assert [i for i, _ in got] == [i for i, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-7)
    assert got[0][0].name == "a_multiply_c" and got[0][1] > 0.0005


def test_two_hundred_candidates_in_two_jobs(spark):
    df = models.with_folds(frame(spark), 3, 1)
    many = {f"k{i}": F.pow(F.col("c"), F.lit(2)) * (i + 1) + F.col("b") / 1e6 for i in range(200)}
    lifts = moments.candidate_lifts(df, ["a", "b", "c"], "y", "_fold", 3, many)
    assert len(lifts) == 200 and all(np.isfinite(v) for v in lifts.values())


def test_odd_frames(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 4.1, 0), (None, 1.0, 1), (3.0, 5.9, 7)], "x double, y double, f int")
    scores = moments.ridge_scores(moments.fold_moments(df, ["x"], "y", "f", 3))
    assert scores[2] == {"r2": None, "rmse": None, "mse": None} and scores[1]["r2"] is None and scores[0]["mse"] > 0
    assert moments.ridge_scores(moments.fold_moments(df.limit(0), ["x"], "y", "f", 2))[0]["mse"] is None
