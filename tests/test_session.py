import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import identity, models, prep, splits
from loomtab.plans.bundle import Predictor, export_bundle, load_bundle
from loomtab.plans.lake import lineage_closure
from loomtab.plans.reporting import docs_json
from loomtab.session import ExperimentConfig, ExperimentSession, exact_sample
from loomtab.sources import tables


def frame(spark, n=240):
    r = np.random.default_rng(3)
    a, b = r.normal(size=n), r.normal(size=n)
    rows = [(float(x), float(y) if i % 9 else None, "red" if i % 3 else "blue", f"g{i % 12}", i, int(x + 0.3 * (i % 3 > 0) > 0)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, colour string, g string, t int, y int")


def test_run_saves_what_predicts(spark, tmp_path):
    df = frame(spark)
    session = ExperimentSession(spark, str(tmp_path))
    config = ExperimentConfig("y", models=("linear",), folds=3, ignore=("g",), split="stratified", calibration="platt", leakage=0.2)
    board = session.run(config, df).collect()
    assert {r.model for r in board} == {"naive", "linear"}
    best = next(r for r in board if r.model == "linear")
    assert best.score > 0.9 and best.lift["accuracy"] > 0
    out = session.predictor(best.artifact_path)(df)
    assert out.where((F.col("prediction") == F.col("y")) & F.col("score").between(0, 1)).count() > 200
    copy = session.export("classification", str(tmp_path / "bundle"))
    assert load_bundle(spark, copy)(df).select(F.sum("prediction")).first() == out.select(F.sum("prediction")).first()
    leaks = [json.loads(e.config)["feature"] for e in session.events().where("event = 'leakage_found'").collect()]
    assert leaks == ["a"]


def test_resume_and_promotion(spark, tmp_path):
    df = frame(spark, 90)
    session = ExperimentSession(spark, str(tmp_path))
    config = ExperimentConfig("y", metrics=("accuracy",), models=("linear",), folds=2, share=0.5, resume=True)
    one = session.run(config, df).collect()
    lines = session.events().count()
    two = session.run(config, df).collect()
    assert {r.run_id for r in one} == {r.run_id for r in two} and session.events().count() == lines + 1
    entry = {"model": "m", "run_id": "r", "score": 0.1, "metric_name": "accuracy", "artifact_path": "", "registered_at": ""}
    assert not session.promote("classification", entry) and session.promote("classification", entry, force=True)


def test_noise_is_left_out(spark, tmp_path):
    df = frame(spark, 200).select("a", "b", F.when(F.col("t") < 4, 1 - F.col("y")).otherwise(F.col("y")).alias("y"))
    session = ExperimentSession(spark, str(tmp_path))
    session.run(ExperimentConfig("y", metrics=("accuracy",), models=("linear",), folds=2, noise=0.2), df)
    found = json.loads(session.events().where("event = 'noise_found'").first().config)
    assert found["rows"] == 200 and found["issues"] >= 1 and len(found["first"]) == min(100, found["issues"])


@pytest.mark.parametrize("name", ["linear", "gbt", "forest", "naive"])
def test_models_survive_saving(spark, tmp_path, name):
    df = frame(spark, 80)
    for task, label in (("classification", "y"), ("regression", "a")):
        settings = {"trees": 3, "depth": 2} if name in ("gbt", "forest") else {}
        fitted = models.make_model(name, task, **settings)(df, ["b", "t"], label)
        fitted.save(spark, str(tmp_path / name))
        again = models.load_model(spark, str(tmp_path / name))
        assert again(df).select("prediction").collect() == fitted(df).select("prediction").collect()


def test_bundle_keeps_large_code_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prep, "INLINE_CODES", 5)
    df = frame(spark, 100)
    p = Predictor(prep.fit_prep(df, "y"), models.make_model("linear", "classification")(prep.fit_prep(df, "y").transform(df), ["a", "g"], "y"))
    assert p.prep.tables
    again = load_bundle(spark, export_bundle(spark, str(tmp_path / "b"), p))
    assert sorted(again(df).select("t", "g", "prediction").collect()) == sorted(p(df).select("t", "g", "prediction").collect())


def test_exact_sample(spark):
    df = spark.createDataFrame([(i % 3,) for i in range(50)], "x int")
    got = exact_sample(df, 0.3, 1)
    assert got.count() == 15 and got.columns == ["x"]
    assert sorted(got.collect()) == sorted(exact_sample(df.repartition(5), 0.3, 1).collect())


def test_lineage_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("x", "c")], "upstream string, downstream string")
    assert sorted(r[0] for r in lineage_closure(edges, "c").collect()) == ["a", "b", "c", "x"]


def test_ranges_and_plain_keys(spark):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("v"), F.concat(F.lit("key-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("row_id"))
    bounds = list(range(3, 290, 11))
    got = df.select("v", splits.range_of(F.col("v"), bounds).alias("r")).collect()
    assert all(x.r == sum(b <= x.v for b in bounds) for x in got)
    folds = {r.row_id: r.fold for r in splits.kfold(df.select("row_id"), 3).where("role = 'validation'").collect()}
    assert [folds[f"key-{i:04d}"] for i in range(300)] == [i // 100 for i in range(300)]


def test_row_ids_of_many_copies(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")] * 25 + [(2, None)], "x int, digest string")
    plain = sorted(r.row_id for r in identity.with_row_ids(df).collect())
    monkeypatch.setattr(identity, "COPIES", 4)
    assert sorted(r.row_id for r in identity.with_row_ids(df).collect()) == plain and len(set(plain)) == 26


def test_command_line(spark, tmp_path, capsys):
    from loomtab.cli import main

    data, work = str(tmp_path / "data.parquet"), str(tmp_path / "work")
    frame(spark, 120).drop("g").write.parquet(data)
    say = lambda *words: (main(["--workspace", work, *words]), capsys.readouterr().out)[1]
    assert json.loads(say("plan", "--data", data, "--target", "y"))["rows"] == 120
    product = say("ingest", "--data", data).strip()
    assert say("verify", "bronze", product).strip() == "as committed" and say("lineage", product) == ""
    assert "linear" in say("run", "--data", data, "--target", "y", "--models", "linear", "--folds", "2", "--split", "stratified", "--calibration", "isotonic")
    assert json.loads(say("registry"))["classification"]["model"] == "linear"
    bundle = say("export", "classification", str(tmp_path / "bundle")).strip()
    say("predict", "--bundle", bundle, "--data", data, "--out", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("score between 0 and 1").count() == 120


def test_embedding_strategy(spark, tmp_path):
    df = frame(spark, 160).withColumn("shop", F.concat(F.lit("s"), (F.col("t") % 60).cast("string")))
    session = ExperimentSession(spark, str(tmp_path))
    board = session.run(ExperimentConfig("y", metrics=("accuracy",), models=("linear",), folds=2, ignore=("g",), strategy="embedding"), df).collect()
    best = next(r for r in board if r.model == "linear")
    p = session.predictor(best.artifact_path)
    assert set(p.embeddings) == {"shop"} and {"shop_emb_0", "shop_emb_1"} <= set(p.model.features)
    assert p(df.withColumn("shop", F.lit("unseen"))).where("prediction in (0, 1)").count() == 160


def test_published_documents(spark, tmp_path):
    session = ExperimentSession(spark, str(tmp_path))
    session.run(ExperimentConfig("y", metrics=("accuracy",), models=("linear",), folds=2), frame(spark, 60))
    found = docs_json(session.events(), session.registry.load())
    runs = json.loads(found["runs"])
    assert {r["model"] for r in runs} == {"naive", "linear"} and "artifact_path" not in runs[0]
    assert json.loads(found["summary"])["champions"]["classification"]["model"] == "linear"


def test_files_and_views(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    ref = tables.add_file(spark, str(tmp_path / "a.txt"), str(tmp_path / "store"))
    assert ref.size == 5 and ref.digest == hashlib.sha256(b"hello").hexdigest()
    with pytest.raises(tables.DataLoadError):
        tables.add_file(spark, str(tmp_path / "a.txt"), str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "x|y"), (2, None)], "a int, b string").coalesce(1)
    tables.write_json(df, str(tmp_path / "j"))
    assert {r.a: r.b for r in spark.read.json(str(tmp_path / "j")).collect()} == {1: "x|y", 2: None}
    assert tables.to_markdown(df.orderBy("a")) == "| a | b |\n| - | - |\n| 1 | x\\|y |\n| 2 |  |"
