"""Exact metrics as aggregates over (label, prediction or score) columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import col

#: Metrics for which less is better.
LOWER_BETTER = frozenset({"rmse", "mae", "mse", "log_loss", "loss", "error"})
EPSILON = 2.220446049250313e-16


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: rmse, mae, r2."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    agg = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("var"))
    return agg.select(F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("var"))).alias("r2"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy, and F1 averaged over the labels seen in truth or prediction (0 where undefined)."""
    c = confusion(df, label, prediction)
    sides = F.explode(F.array(F.struct(F.col("label").alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("prediction").alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    each = c.select("n", (F.col("label") == F.col("prediction")).cast("int").alias("hit"), sides.alias("s"))
    per = each.groupBy("s.k").agg((2 * F.sum(F.col("n") * F.col("hit") * F.col("s.t"))).alias("twice"), F.sum("n").alias("both"))
    f1 = per.agg(F.avg(F.try_divide(F.col("twice"), F.col("both"))).alias("f1_macro"))
    accuracy = c.agg(F.try_divide(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return accuracy.crossJoin(F.broadcast(f1))


def roc_auc(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """One row (roc_auc): the exact Mann-Whitney statistic for labels 0 and 1; null if a class is missing.

    Equal scores are counted together first, so that the running count is over distinct scores, range by range.
    A row counts as many times as ``weight`` says.
    """
    one = col(weight) if weight else F.lit(1)
    by = df.groupBy(col(score).cast("double").alias("s")).agg(F.sum(F.when(col(label) == 1, one).otherwise(0)).alias("p"), F.sum(F.when(col(label) == 1, 0).otherwise(one)).alias("n"))
    edges = [float(x) for x in (by.agg(F.percentile_approx("s", [i / 64 for i in range(1, 64)], 1000)).first()[0] or [])]
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("s"))) if edges else F.lit(0)
    cut = by.withColumn("part", part)
    parts = cut.groupBy("part").agg(F.sum("n").alias("pn"))
    before = parts.withColumn("base", F.sum("pn").over(Window.orderBy("part")) - F.col("pn")).drop("pn")  # at most 64 rows
    run = F.sum("n").over(Window.partitionBy("part").orderBy("s")) - F.col("n")
    placed = cut.withColumn("run", run).join(F.broadcast(before), "part")
    total = placed.agg(F.sum(F.col("p") * (F.col("base") + F.col("run") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / F.col("p") / F.col("n")).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, label: str, probability: str, classes: int) -> float | None:
    """Mean one-against-rest AUC over all classes of an array of probabilities; null if one is undefined."""
    found = [roc_auc(df.select((col(label) == k).cast("int").alias("y"), F.get(col(probability), F.lit(k)).alias("s")), "y", "s").first()[0] for k in range(classes)]
    return None if None in found else sum(found) / len(found)


def log_loss(df: DataFrame, label: str, probability: str) -> DataFrame:
    """One row (log_loss) for labels 0 and 1; probabilities clipped at machine epsilon."""
    p = F.least(F.greatest(col(probability).cast("double"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    return df.agg((-F.avg(F.when(col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def fold_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, std): over folds, with the population deviation."""
    return df.groupBy(*by).agg(F.avg(col(value)).alias("mean"), F.stddev_pop(col(value)).alias("std"))


def lower_is_better(metric: str) -> bool:
    plugin = METRICS.get(metric)
    return metric in LOWER_BETTER or bool(plugin and getattr(plugin, "lower_is_better", False))


def lift(score: Column, baseline: Column, metric: str) -> Column:
    """Relative gain over the baseline in the metric's direction; null without a baseline or with 0."""
    change = F.when(baseline != 0, (score - baseline) / F.abs(baseline))
    return -change if lower_is_better(metric) else change


#: Further metrics by name: functions (df, label, prediction) -> one-row DataFrame, with ``lower_is_better`` if so.
METRICS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}


def register_metric(name: str, build: Callable[[DataFrame, str, str], DataFrame]) -> None:
    METRICS[name] = build
