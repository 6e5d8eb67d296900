"""The classifier between two samples where few value sets hold most rows."""

import pytest
from pyspark.sql import functions as F

from loomtab.operators import drift, metrics


def side(spark, n, hot, k):
    """``n`` rows; ``hot`` of every 10 are 0, the others go over 1 to ``k``."""
    return spark.range(n).select(F.when(F.col("id") % 10 < hot, 0).otherwise(F.col("id") % k + 1).cast("double").alias("a"))


def test_few_values_beyond_the_cap(spark):
    a, b = side(spark, 4000, 8, 3), side(spark, 4000, 2, 3)
    # P(b > a) + P(b = a) / 2 of values 0 in 8 and 2 of 10 rows, the others spread evenly
    want = 0.8 * 0.8 + 0.8 * 0.2 / 2 + 0.2 * 0.8 / 2
    assert drift.domain_auc(a, b, cap=500) == pytest.approx(want, abs=0.02)
    assert drift.domain_auc(a, a, cap=500) == pytest.approx(0.5, abs=0.02)
    assert drift.detect(a, b, "domain_classifier")["drift_detected"]


def test_one_value_on_each_side(spark):
    a, b = side(spark, 300, 10, 1), side(spark, 300, 10, 1).select((F.col("a") + 9).alias("a"))
    assert drift.domain_auc(a, b) == 1.0 and drift.domain_auc(a, a) == 0.5
    assert drift.domain_auc(a, b.limit(1)) == 0.5 and drift.domain_auc(a.limit(2), b.limit(3)) == 1.0


def test_weighted_auc(spark):
    df = spark.createDataFrame([(1, 0.5, 3), (0, 0.5, 2), (0, 0.1, 4), (1, 0.9, 1)], "y int, s double, w int")
    flat = df.select("y", "s", F.explode(F.sequence(F.lit(1), "w")))
    assert metrics.roc_auc(df, "y", "s", "w").first()[0] == pytest.approx(metrics.roc_auc(flat, "y", "s").first()[0])
