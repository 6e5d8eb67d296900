"""Permutation of frames with few distinct rows."""

from pyspark.sql import functions as F

from loomtab.operators import audit, features, models


def binary(spark, n=600):
    """A label, a column equal to it, and a flag that has nothing to do with it."""
    return spark.range(n).select((F.col("id") % 2).cast("double").alias("leak"), (F.col("id") % 3 == 0).cast("double").alias("flag"), (F.col("id") % 2).cast("int").alias("y"))


def test_binary_leak_is_found(spark):
    df = binary(spark)
    assert [f.feature for f in audit.leakage_audit(df, ["flag", "leak"], "y", "classification", folds=2)] == ["leak"]
    drop = features.permutation_importance(df, ["flag", "leak"], "y", models.logistic(), "roc_auc", 2)
    assert 0.4 < drop["leak"] < 0.6 and abs(drop["flag"]) < 0.1


def test_copies_of_a_row_move(spark, monkeypatch):
    df = binary(spark)
    out = features.permuted(df, "leak", 1)
    assert out.columns == df.columns and out.count() == 600 and out.where("leak = 1").count() == 300
    assert 240 < out.where("leak = y").count() < 360
    monkeypatch.setattr(features, "COPIES", 7)
    copies = features.numbered(df)
    assert copies.drop("_copy").exceptAll(df).isEmpty() and copies.distinct().count() == copies.count() == 600
    assert copies.where("_copy >= 200").isEmpty() and features.permuted(df, "leak", 1).exceptAll(out).isEmpty()
