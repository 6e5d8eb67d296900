import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import models
from loomtab.operators.labels import LabelError, fit_labels
from loomtab.plans.bundle import load_bundle
from loomtab.session import ExperimentConfig, ExperimentSession

NAMES = ["low", "middle", "upper"]


def blobs(spark, n=150, kind="string"):
    r = np.random.default_rng(8)
    y = r.integers(0, 3, n)
    x = r.normal(size=(n, 2)) + 2.2 * np.stack([y == 1, y == 2], 1)
    rows = [(float(a), float(b), NAMES[k] if kind == "string" else int(10 * k + 5)) for (a, b), k in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, f"a double, b double, y {kind}")


def auc_ovr(y, p):
    out = []
    for k in range(p.shape[1]):
        s, t = p[:, k], y == k
        out.append(np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[t] for b in s[~t]]))
    return float(np.mean(out))


def test_three_classes_of_text_in_a_run(spark, tmp_path):
    df = blobs(spark).unionByName(blobs(spark).limit(2).withColumn("y", F.lit(None).cast("string")))
    session = ExperimentSession(spark, str(tmp_path))
    settings = {"gbt": {"trees": 1, "depth": 2}}
    config = ExperimentConfig("y", models=("gbt",), folds=2, settings=settings, resume=True)
    board = {r.model: r for r in session.run(config, df).collect()}
    assert set(board) == {"naive", "linear", "gbt"}
    assert board["naive"].cv_scores["roc_auc"] == 0.5 and board["naive"].lift["roc_auc"] == 0
    for name in ("linear", "gbt"):
        assert board[name].cv_scores["roc_auc"] > 0.8 and board[name].lift["roc_auc"] == pytest.approx(2 * board[name].cv_scores["roc_auc"] - 1)
    out = session.predictor(board["linear"].artifact_path)(df.where("y is not null")).select("y", "prediction", "probability").collect()
    assert {r.prediction for r in out} <= set(NAMES) and np.mean([r.y == r.prediction for r in out]) > 0.7
    # what a resumed run adds is still held against the first run's baseline
    lines = [json.loads(x) for x in (tmp_path / "events.jsonl").read_text().splitlines()]
    (tmp_path / "events.jsonl").write_text("".join(json.dumps(e) + "\n" for e in lines if e.get("model") != "linear"))
    resumed = {r.model: r for r in session.run(config, df).collect()}
    assert resumed["linear"].lift == board["linear"].lift and resumed["linear"].lift["accuracy"] > 0.3


def test_auc_of_each_model_against_brute_force(spark):
    df = fit_labels(blobs(spark), "y").encode(blobs(spark))
    for name, settings in (("linear", {}), ("gbt", {"trees": 2, "depth": 2}), ("forest", {"trees": 3, "depth": 2}), ("perceptron", {"hidden": 3}), ("naive", {})):
        scored = models.make_model(name, "classification", 3, **settings)(df, ["a", "b"], "y")(df)
        rows = scored.select("y", "probability").collect()
        want = auc_ovr(np.array([r.y for r in rows]), np.array([r.probability for r in rows]))
        assert models.measure(scored, "y", ["roc_auc"], 3)["roc_auc"] == pytest.approx(want, abs=1e-12)


def brute_platt(s, hit):
    a, b, n1 = 0.0, np.log((hit.sum() + 1) / ((~hit).sum() + 1)), hit.sum()
    t = np.where(hit, (n1 + 1) / (n1 + 2), 1 / (len(s) - n1 + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p)
        h = np.array([[(w * s * s).sum() + 1e-9, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-9]])
        da, db = np.linalg.solve(h, [((p - t) * s).sum(), (p - t).sum()])
        a, b = a - 0.5 * da, b - 0.5 * db
    return lambda x: 1 / (1 + np.exp(-(a * x + b)))


@pytest.mark.parametrize("classes", [2, 3])
def test_calibration_against_brute_force(spark, tmp_path, classes):
    df = fit_labels(blobs(spark), "y").encode(blobs(spark))
    if classes == 2:
        df = df.withColumn("y", (F.col("y") > 0).cast("int"))
    df = df.cache()
    fit = models.make_model("linear", "classification")
    got = models.fit_calibrated(df, ["a", "b"], "y", fit, classes, folds=2)
    rows = models.with_folds(df, 2, 42, ["a", "b", "y"]).cache()
    want = 0
    for k, (model, _) in enumerate(got.members):
        held = model(rows.where(F.col("_fold") == k)).select("y", "probability").collect()
        s, y = np.array([r.probability for r in held]), np.array([r.y for r in held])
        p = np.array([r.probability for r in model(df).orderBy("a").collect()])
        if classes == 2:
            one = brute_platt(s[:, 1], y == 1)(p[:, 1])
            want = want + np.stack([1 - one, one], 1)
        else:
            each = np.stack([brute_platt(s[:, c], y == c)(p[:, c]) for c in range(3)], 1)
            want = want + each / each.sum(1, keepdims=True)
    have = np.array([r.probability for r in got(df).orderBy("a").collect()])
    assert np.allclose(have, want / 2, atol=1e-6) and np.allclose(have.sum(1), 1)
    got.save(spark, str(tmp_path / "m"))
    again = np.array([r.probability for r in models.load_model(spark, str(tmp_path / "m"))(df).orderBy("a").collect()])
    assert np.array_equal(have, again)


def test_calibrated_run_of_numbers_as_classes(spark, tmp_path):
    df = blobs(spark, kind="int")
    session = ExperimentSession(spark, str(tmp_path))
    board = session.run(ExperimentConfig("y", metrics=("accuracy",), models=("linear",), folds=2, calibration="isotonic"), df).collect()
    best = next(r for r in board if r.model == "linear")
    out = load_bundle(spark, best.artifact_path)(df).collect()
    assert {r.prediction for r in out} == {5, 15, 25} and all(abs(sum(r.probability) - 1) < 1e-9 for r in out)


def test_labels(spark):
    df = spark.createDataFrame([(10,), (9,), (None,), (9,)], "y int")
    found = fit_labels(df, "y")
    assert found.values == ["9", "10"]
    back = found.encode(df).select("y", found.decode(F.col("y").cast("double")).alias("v"))
    assert sorted(map(tuple, back.collect())) == [(0, 9), (0, 9), (1, 10)] and back.schema["v"].dataType.simpleString() == "int"
    with pytest.raises(LabelError):
        fit_labels(spark.range(1001).withColumnRenamed("id", "y"), "y")
