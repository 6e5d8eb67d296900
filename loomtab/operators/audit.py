"""Audits: label noise, leakage, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import col
from .features import permuted, placed
from .models import cross_validate, logistic, out_of_fold, ridge
from .quantiles import order_statistics


@dataclass(frozen=True)
class NoiseReport:
    """``scores``: (row_id, quality_score, is_issue); ``joint[i][j]``: rows of label i that are estimated to be of class j."""

    enabled: bool
    n_rows: int = 0
    n_issues: int = 0
    scores: DataFrame | None = None
    joint: list[list[int]] | None = None

    @property
    def noise_rate(self) -> float:
        return self.n_issues / max(self.n_rows, 1)


def confident_counts(scored: DataFrame, classes: int) -> list[list[int]]:
    """How many rows of label i are confidently of class j, from ``scored`` (y, probability).

    A row is confidently of the most probable class among those whose probability is at least the mean that rows of
    that label have for it; a row without such a class is not counted.
    """
    means = {r.y: r.m for r in scored.groupBy("y").agg(F.avg(F.get("probability", F.col("y"))).alias("m")).collect()}
    bars = F.array(*[F.lit(float(means.get(k, 2.0))) for k in range(classes)])
    sure = F.zip_with("probability", bars, lambda p, t: F.when(p >= t, p).otherwise(-1.0))
    best = F.when(F.array_max(sure) >= 0, F.array_position(sure, F.array_max(sure)) - 1)
    out = [[0] * classes for _ in range(classes)]
    for r in scored.groupBy("y", best.alias("j")).agg(F.count(F.lit(1)).alias("n")).where("j is not null").collect():
        out[r.y][int(r.j)] = r.n
    return out


def estimated_joint(counts: list[list[int]], sizes: list[int]) -> list[list[int]]:
    """The confident counts brought to the labels' true numbers, as whole rows; a label without any counts as clean."""
    out = []
    for i, (row, n) in enumerate(zip(counts, sizes, strict=True)):
        total = sum(row)
        out.append([(2 * c * n + total) // (2 * total) for c in row] if total else [n * (i == j) for j in range(len(row))])
    return out


def noisy_rows(scored: DataFrame, joint: list[list[int]]) -> DataFrame:
    """(row_id, quality_score, is_issue) of all rows of ``scored`` (row_id, y, probability).

    Of label i, as many rows as the joint puts into class j are issues: those in which class j is ahead of the label by
    most, and only where another class is the most probable.  Rows that tie with the last one are issues too.  The lead
    from which on a cell's rows count is an exact order statistic, so no rows are sorted.
    """
    classes = len(joint)
    own = F.get("probability", F.col("y"))
    cells = {f"{i},{j}": joint[i][j] for i in range(classes) for j in range(classes) if i != j and joint[i][j]}
    best = F.array_position("probability", F.array_max("probability")) - 1
    leads = scored.select("y", F.posexplode(F.transform("probability", lambda p: p - own)).alias("j", "lead"))
    leads = leads.select(F.concat_ws(",", "y", "j").alias("column"), (-F.col("lead")).alias("value")).where(F.col("column").isin(list(cells)))
    last = order_statistics(leads, lambda cell, n: [min(cells[cell], n) - 1]) if cells else {}
    issue = F.lit(False)
    for cell, found in last.items():
        i, j = map(int, cell.split(","))
        issue = issue | ((F.col("y") == i) & (F.get("probability", F.lit(j)) - own >= -next(iter(found.values()))))
    return scored.select("row_id", own.alias("quality_score"), (issue & (best != F.col("y"))).alias("is_issue"))


def label_noise(df: DataFrame, features: list[str], label: str, folds: int = 3, seed: int = 42) -> NoiseReport:
    """Confident learning on out-of-fold probabilities (labels 0, 1, ...): the joint of given and likely labels is
    estimated, and as many rows as it holds off its diagonal are issues.  The quality score is the probability of the row's own label.
    """
    known = df.where(col(label).isNotNull())
    sizes = {r.y: r.n for r in known.groupBy(col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return NoiseReport(False)
    classes = max(sizes) + 1
    scored = out_of_fold(known, features, label, logistic(scaled=True), folds, seed, ["row_id"]).select("row_id", col(label).cast("int").alias("y"), "probability").cache()
    joint = estimated_joint(confident_counts(scored, classes), [sizes.get(k, 0) for k in range(classes)])
    scores = noisy_rows(scored, joint)
    n, issues = scores.agg(F.count(F.lit(1)), F.count_if("is_issue")).first()
    return NoiseReport(True, n, issues, scores, joint)


def drop_noise(df: DataFrame, scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose quality score is at least ``least``; rows without one stay."""
    bad = scores.where(F.col("quality_score") < least).select("row_id")
    return df.join(bad, "row_id", "left_anti")


@dataclass(frozen=True)
class LeakageFinding:
    feature: str
    baseline: float
    permuted: float

    @property
    def drop(self) -> float:
        return self.baseline - self.permuted


def leakage_audit(df: DataFrame, features: list[str], label: str, task: str, threshold: float = 0.15, folds: int = 3, seed: int = 42, classes: int = 2) -> list[LeakageFinding]:
    """Features whose permutation lowers the cross-validated score (roc_auc or r2) by over ``threshold``, worst first.

    Copies of a row are numbered, so that they go to folds and places of their own.
    """
    metric, fit = ("r2", ridge()) if task == "regression" else ("roc_auc", logistic(scaled=True))
    rows = placed(df.select(*[col(c) for c in [*features, label]])).cache()
    try:
        keys = [*features, label, "_copy"]
        base = cross_validate(rows, features, label, fit, [metric], folds, seed, classes=classes, keys=keys)[metric][0]
        found = []
        for i, f in enumerate(features):
            score = cross_validate(permuted(rows, f, seed + i), features, label, fit, [metric], folds, seed, classes=classes, keys=keys)[metric][0]
            if base - score > threshold:
                found.append(LeakageFinding(f, round(base, 4), round(score, 4)))
        return sorted(found, key=lambda x: -x.drop)
    finally:
        rows.unpersist()
