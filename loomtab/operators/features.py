"""Target transforms, interactions, importance, pruning and encodings of high-cardinality columns."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import col
from .models import Fit, cross_validate, measure, with_folds
from .moments import candidate_lifts
from .splits import positions, value_codes


@dataclass(frozen=True)
class TargetTransform:
    """none, log1p, yeo_johnson or box_cox; the power transforms are standardised."""

    kind: str
    lam: float = 1.0
    mean: float = 0.0
    std: float = 1.0

    def forward(self, y: Column) -> Column:
        y = y.cast("double")
        if self.kind == "log1p":
            return F.log1p(y)
        if self.kind == "none":
            return y
        z = S.yeo_johnson(y, self.lam) if self.kind == "yeo_johnson" else S.box_cox(y, self.lam)
        return (z - self.mean) / self.std

    def inverse(self, z: Column) -> Column:
        if self.kind == "log1p":
            return F.expm1(z)
        if self.kind == "none":
            return z
        z = z * self.std + self.mean
        return S.yeo_johnson_inverse(z, self.lam) if self.kind == "yeo_johnson" else S.box_cox_inverse(z, self.lam)


def skewness(df: DataFrame, target: str) -> float | None:
    """Population skewness."""
    return df.agg(F.skewness(col(target).cast("double"))).first()[0]


def fit_target_transform(df: DataFrame, target: str, kind: str = "auto") -> TargetTransform:
    """``auto``: none up to a skewness of 1; else box_cox for positive targets and yeo_johnson for others.

    The exponent maximises the likelihood; a grid of exponents is one aggregate over the data, refined twice.
    """
    y = col(target).cast("double")
    skew, least, n, logs = df.agg(F.skewness(y), F.min(y), F.count(y), F.sum(F.when(y > 0, F.log(y)))).first()
    if kind == "auto":
        kind = "none" if skew is None or abs(skew) <= 1.0 else "box_cox" if least > 0 else "yeo_johnson"
    if kind in ("none", "log1p"):
        return TargetTransform(kind)
    if kind == "box_cox" and least <= 0:
        raise ValueError("box_cox needs a positive target")
    change = S.box_cox if kind == "box_cox" else S.yeo_johnson
    jacobian = logs if kind == "box_cox" else df.agg(F.sum(F.signum(y) * F.log1p(F.abs(y)))).first()[0]
    low, high = -2.0, 2.0
    best = 1.0
    for _ in range(4):
        grid = [low + (high - low) * i / 12 for i in range(13)]
        spread = df.agg(*[F.var_pop(change(y, g)) for g in grid]).first()
        value = [-n / 2 * math.log(v) + (g - 1) * jacobian if v and v > 0 else -math.inf for g, v in zip(grid, spread, strict=True)]
        best = grid[max(range(13), key=value.__getitem__)]
        width = (high - low) / 12
        low, high = best - width, best + width
    mean, std = df.agg(F.avg(change(y, best)), F.stddev_pop(change(y, best))).first()
    return TargetTransform(kind, best, mean, std or 1.0)


#: Copies of a row that one task numbers at a time.
COPIES = 10_000


def numbered(df: DataFrame, name: str = "_copy") -> DataFrame:
    """The frame with each row's number among equal rows.

    Equal rows are counted, and the counts unfolded again in stretches of ``COPIES``, which are dealt to all tasks.
    """
    names = [col(c) for c in df.columns]
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    stretch = counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))).alias("_k"))
    dealt = stretch.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "_k")
    first = F.col("_k") * COPIES
    return dealt.select(*names, F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1)).alias(name))


def placed(df: DataFrame) -> DataFrame:
    """The frame with ``_copy``, a row's number among equal rows, and ``_at``, its position in the order of a hash of both."""
    rows = df if "_copy" in df.columns else numbered(df)
    names = [col(c) for c in rows.columns]
    return positions(rows, [F.lower(F.lpad(F.hex(F.xxhash64(F.lit(7919), *names)), 16, "0")), *names], "_at", hexed=True)


def permuted(df: DataFrame, column: str, seed: int) -> DataFrame:
    """The frame with one column's values dealt to other rows, by a permutation of all rows.

    Rows have positions in a hash order, of ``placed`` if the frame comes from there, so that all columns can be permuted off
    one numbering; the row at position i gets the value of that from which (a i + b) mod n leads to it.
    """
    rows = df if "_at" in df.columns else placed(df)
    n = rows.count()
    if n < 2:
        return df
    r = random.Random(f"{seed}:{column}")
    step = r.randrange(1, min(n, 1 << 20)) if n > 2 else 1
    while math.gcd(step, n) > 1:
        step = step % min(n, 1 << 20) + 1
    to = (F.col("_at") % n * step + r.randrange(1, n)) % n
    values = rows.select(to.alias("_at"), col(column).alias(column))
    return rows.drop(column).join(values, "_at").select(*[col(c) for c in df.columns])


def permutation_importance(df: DataFrame, features: list[str], label: str, fit: Fit, metric: str, repeats: int = 5, seed: int = 42, classes: int = 2) -> dict[str, float]:
    """Mean loss of the metric when a feature is permuted; the model is fitted once, and the rows are numbered once."""
    rows = placed(df.select(*[col(c) for c in [*features, label]])).cache()
    try:
        score = fit(rows, features, label)
        base = measure(score(rows), label, [metric], classes)[metric]
        out = {}
        for i, f in enumerate(features):
            drops = [base - measure(score(permuted(rows, f, seed + i + 1000 * r)), label, [metric], classes)[metric] for r in range(repeats)]
            out[f] = sum(drops) / repeats
        return out
    finally:
        rows.unpersist()


def top_features(importance: dict[str, float], k: int) -> list[str]:
    return sorted(importance, key=lambda f: (-importance[f], f))[:k]


def prune_features(importance: dict[str, float], least: float = 0.001) -> list[str]:
    """Features worth keeping, in their order; at least the best one."""
    return [f for f, v in importance.items() if v >= least] or top_features(importance, 1)


@dataclass(frozen=True)
class Interaction:
    kind: str
    a: str
    b: str

    @property
    def name(self) -> str:
        return f"{self.a}_{self.kind}_{self.b}"

    @property
    def expression(self) -> Column:
        a, b = col(self.a), col(self.b)
        return S.multiply(a, b) if self.kind == "multiply" else S.safe_ratio(a, b)


def interaction_candidates(features: list[str], cap: int = 200) -> list[Interaction]:
    """Products and ratios of all pairs, at most ``cap``."""
    return [Interaction(kind, a, b) for a, b in combinations(features, 2) for kind in ("multiply", "ratio")][:cap]


def discover_interactions(df: DataFrame, features: list[str], label: str, fit: Fit, metric: str, top: list[str], least_lift: float = 0.01, cap: int = 200, folds: int = 3, seed: int = 42, classes: int = 2) -> list[tuple[Interaction, float]]:
    """Candidates whose column lifts the cross-validated metric by over ``least_lift``, best first.

    With ``ridge`` and r2 all candidates are scored from one pass of sums; other models are fitted for each.
    """
    if metric == "r2" and getattr(fit, "alpha", None) is not None:
        found = interaction_candidates(top, cap)
        lifts = candidate_lifts(with_folds(df, folds, seed, name="_fold"), features, label, "_fold", folds, {c.name: c.expression for c in found}, fit.alpha)
        return sorted(((c, lifts[c.name]) for c in found if lifts[c.name] > least_lift), key=lambda x: -x[1])
    base = cross_validate(df, features, label, fit, [metric], folds, seed, classes=classes)[metric][0]
    kept = []
    for c in interaction_candidates(top, cap):
        wide = df.withColumn(c.name, c.expression)
        lift = cross_validate(wide, [*features, c.name], label, fit, [metric], folds, seed, classes=classes, keys=df.columns)[metric][0] - base
        if lift > least_lift:
            kept.append((c, lift))
    return sorted(kept, key=lambda x: -x[1])


def engineer(df: DataFrame, features: list[str], label: str, fit: Fit, metric: str, k: int = 5, seed: int = 42, classes: int = 2) -> tuple[DataFrame, list[str]]:
    """Fit, take the most important features, add interactions that help, refit, prune."""
    first = permutation_importance(df, features, label, fit, metric, 1, seed, classes)
    found = discover_interactions(df, features, label, fit, metric, top_features(first, k), seed=seed, classes=classes)
    wide = df.withColumns({i.name: i.expression for i, _ in found}) if found else df
    names = [*features, *[i.name for i, _ in found]]
    return wide, prune_features(permutation_importance(wide, names, label, fit, metric, 1, seed, classes))


def contiguous_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values ascending, coded from 0."""
    return value_codes(df, column)


def with_codes(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """Codes by a join; an unseen value gets 0."""
    table = codes.select(col("value").alias("_v"), F.col("code").alias("_c"))
    return df.join(table, col(column) == F.col("_v"), "left").withColumn(name, F.coalesce("_c", F.lit(0))).drop("_v", "_c")


def fit_frequency_encoding(df: DataFrame, column: str, target: str | None = None, smoothing: float = 20.0) -> DataFrame:
    """(value, emb_0 frequency[, emb_1 smoothed target mean]): a dense stand-in for a learned embedding table."""
    n = df.count()
    by = df.groupBy(col(column).alias("value"))
    if target is None:
        return by.agg((F.count(F.lit(1)) / n).alias("emb_0"))
    mean = df.agg(F.avg(col(target).cast("double"))).first()[0]
    return by.agg((F.count(F.lit(1)) / n).alias("emb_0"), ((F.sum(col(target).cast("double")) + smoothing * mean) / (F.count(F.lit(1)) + smoothing)).alias("emb_1"))


def augment(df: DataFrame, columns: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """In place of each column its dense columns ``{column}_emb_{i}``; unseen values get 0."""
    for c in columns:
        table = tables[c]
        dense = [x for x in table.columns if x != "value"]
        named = table.select(F.col("value").alias("_v"), *[F.col(x).alias(f"{c}_{x}") for x in dense])
        df = df.join(named, col(c).eqNullSafe(F.col("_v")), "left").drop("_v", c).fillna(0.0, [f"{c}_{x}" for x in dense])
    return df


def fit_pca(df: DataFrame, columns: list[str], k: int = 32) -> Callable[[DataFrame], DataFrame]:
    """One-hot categories compressed by PCA: a linear stand-in for an autoencoder's bottleneck ``_pca`` (an array)."""
    index = StringIndexer(inputCols=columns, outputCols=[f"_i{i}" for i in range(len(columns))], handleInvalid="keep").fit(df)
    hot = OneHotEncoder(inputCols=[f"_i{i}" for i in range(len(columns))], outputCols=[f"_h{i}" for i in range(len(columns))]).fit(index.transform(df))
    join = VectorAssembler(inputCols=[f"_h{i}" for i in range(len(columns))], outputCol="_v")
    wide = join.transform(hot.transform(index.transform(df)))
    width = len(wide.select("_v").first()[0])
    pca = PCA(k=min(k, width), inputCol="_v", outputCol="_p").fit(wide)
    used = [f"_{x}{i}" for x in "ih" for i in range(len(columns))]
    return lambda new: pca.transform(join.transform(hot.transform(index.transform(new)))).withColumn("_pca", vector_to_array("_p")).drop("_v", "_p", *used)
