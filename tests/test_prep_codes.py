"""Category codes on both sides of the inline bound."""

from pyspark.sql import functions as F

from loomtab.operators import prep
from loomtab.session import ExperimentConfig, ExperimentSession


def words(spark, n):
    return spark.range(3 * n).select(F.concat(F.lit("é"), (F.col("id") % n).cast("string")).alias("c"), (F.col("id") % 2).cast("int").alias("y"))


def test_codes_do_not_depend_on_size(spark, monkeypatch):
    df = words(spark, 1500)
    model = prep.fit_prep(df, "y")
    out = model.transform(df)
    assert out.columns == ["y", "c"] and dict(out.dtypes)["c"] == "int" and out.count() == 4500
    want = {v: i for i, v in enumerate(sorted(f"é{i}" for i in range(1500)))}
    got = model.transform(df.withColumn("name", F.col("c"))).select("name", "c")
    assert {(r[0], r[1]) for r in got.collect()} == {(f, want[f]) for f in want}
    new = spark.createDataFrame([("unseen", 0), (None, 1)], "c string, y int")
    assert [r.c for r in model.transform(new).orderBy("y").collect()] == [1500, 0]
    monkeypatch.setattr(prep, "INLINE_CODES", 10_000)
    assert prep.fit_prep(df, "y").transform(df).exceptAll(out).isEmpty()


def test_two_large_columns_and_nulls(spark):
    df = words(spark, 1300).withColumn("d", F.when(F.col("c") != "é7", F.reverse("c")))
    out = prep.fit_prep(df, "y").transform(df)
    assert out.columns == ["y", "c", "d"] and out.count() == df.count()
    assert out.agg(F.max("c"), F.max("d"), F.count("d")).first()[:] == (1299, 1298, 3900)


def test_large_column_is_a_feature_of_the_session(spark, tmp_path):
    # each value in ten rows, which are told apart by x, so that nearly all values are on both sides of a fold
    df = words(spark, 1500).select("c", (F.col("c") < "é3").cast("int").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).withColumn("x", F.rand(1)).drop("k").cache()
    board = ExperimentSession(spark, str(tmp_path)).run(ExperimentConfig("y", models=("linear",), folds=2, metrics=("roc_auc",)), df)
    assert board.where("model = 'linear'").first().score > 0.9
