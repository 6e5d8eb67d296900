import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import boosting as B
from loomtab.operators import models


def three_rings(n, seed=3):
    """Three classes by distance from the middle: no line parts them."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    y = np.digitize((x**2).sum(1), [0.8, 2.2])
    return [(float(a), float(b), float(round(a)), int(k)) for (a, b), k in zip(x, y, strict=True)]


def brute(bins, y, classes, trees, depth, step, ridge=1.0, least=1e-3):
    """The same boosting by loops: scores of all rows."""
    n, f = bins.shape
    prior = np.log(np.bincount(y, minlength=classes) / n)
    scores = np.tile(prior, (n, 1))
    for _ in range(trees):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k in range(classes):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-16)

            def grow(rows, level, g=g, h=h, k=k):
                part = lambda a, b: a * a / (b + ridge)
                best = None
                if level < depth:
                    for j in range(f):
                        for b in np.unique(bins[rows, j]):
                            left = rows[bins[rows, j] <= b]
                            gl, hl, ga, ha = g[left].sum(), h[left].sum(), g[rows].sum(), h[rows].sum()
                            gain = part(gl, hl) + part(ga - gl, ha - hl) - part(ga, ha)
                            if hl >= least and ha - hl >= least and gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = gain, j, b
                if best is None:
                    scores[rows, k] -= step * g[rows].sum() / (h[rows].sum() + ridge)
                else:
                    _, j, b = best
                    grow(rows[bins[rows, j] <= b], level + 1)
                    grow(rows[bins[rows, j] > b], level + 1)

            grow(np.arange(n), 0)
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_against_loops(spark):
    rows = three_rings(300)
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    features = [F.col(c) for c in "abc"]
    model = B.fit_boosted(df, features, "y", 3, trees=2, depth=3, step=0.3, bins=8)
    x = np.array([r[:3] for r in rows])
    bins = np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.edges)], 1)
    want = brute(bins, np.array([r[3] for r in rows]), 3, 2, 3, 0.3)
    got = np.array([r[0] for r in df.select(model.probability(features)).collect()])
    assert np.allclose(got, want, atol=1e-9)


def test_better_than_a_line_and_saved(spark, tmp_path):
    df = spark.createDataFrame(three_rings(800), "a double, b double, c double, y int")
    train, test = df.where("abs(hash(a, b)) % 4 <> 0").cache(), df.where("abs(hash(a, b)) % 4 = 0").cache()
    score = {}
    for name, fit in (("gbt", models.gbt("classification", 3, trees=7, depth=3, step=0.4)), ("linear", models.make_model("linear", "classification"))):
        fitted = fit(train, ["a", "b", "c"], "y")
        score[name] = models.measure(fitted(test), "y", ["accuracy", "roc_auc", "log_loss"], 3)
        fitted.save(spark, f"{tmp_path}/{name}")
        again = models.load_model(spark, f"{tmp_path}/{name}")
        assert models.measure(again(test), "y", ["accuracy"], 3)["accuracy"] == score[name]["accuracy"]
    assert score["gbt"]["accuracy"] > 0.8 > score["linear"]["accuracy"]
    assert score["gbt"]["roc_auc"] > 0.95 and score["gbt"]["log_loss"] < 0.6


def test_odd_frames(spark):
    one = spark.createDataFrame([(1.0, 0), (1.0, 1), (None, 1), (2.0, None)], "x double, y int")
    model = models.boosted_trees(3, trees=2)(one, ["x"], "y")
    p = [r.probability for r in model(one).collect()]
    assert all(abs(sum(q) - 1) < 1e-9 for q in p)
    none = B.fit_boosted(one.limit(0), [F.col("x")], "y", 2)
    assert none.rounds == []
    with pytest.raises(ValueError):
        B.fit_boosted(one.withColumn("y", F.lit(7)), [F.col("x")], "y", 2)
