"""Ridge regression, cross-validated and extended by candidate columns, from sums of products alone.

One pass gives the products of all base columns (constant, features, label) for each fold, and those of every candidate with
the base and itself.  A fold is left out by subtraction, a candidate is added by a border, and squared errors of a fold follow
from its own sums: any number of folds and candidates costs no further look at the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_number, col


@dataclass(frozen=True)
class FoldMoments:
    """By fold: ``base`` (d x d) products of (1, features, label), ``cross`` (candidates x d), ``squares`` (candidates).

    Columns are taken less ``shift``, the label's last; candidates less ``candidate_shift``.  Shifts are means of all rows, so
    that nothing is lost to large means.
    """

    base: np.ndarray
    cross: np.ndarray
    squares: np.ndarray
    shift: np.ndarray
    candidate_shift: np.ndarray

    @property
    def folds(self) -> int:
        return len(self.base)


def fold_products(df: DataFrame, fold: str, columns: dict[str, Column]) -> DataFrame:
    """(fold, a, b, total): sums of products of each pair of ``columns``, a not after b in their order; null counts as 0."""
    names = list(columns)
    wide = df.select(col(fold).alias("fold"), *[F.coalesce(columns[n].cast("double"), F.lit(0.0)).alias(str(i)) for i, n in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = wide.groupBy("fold").agg(*[F.sum(col(str(i)) * col(str(j))).alias(f"s{k}") for k, (i, j) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"s{k}").alias("total")) for k, (i, j) in enumerate(pairs)])
    return sums.select("fold", F.explode(cells).alias("c")).select("fold", "c.*")


def fold_moments(df: DataFrame, features: list[str], label: str, fold: str, folds: int, candidates: dict[str, Column] | None = None) -> FoldMoments:
    """The moments of rows with a ``fold`` from 0 to ``folds`` - 1; other rows are left out, null and NaN count as 0.

    A task adds up its batches and gives one row for each fold and column, so what is shuffled and what the driver gets
    doesn't grow with the rows.
    """
    candidates = candidates or {}
    base = [F.coalesce(as_number(c), F.lit(0.0)) for c in [*features, label]]
    extra = [F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in candidates.values()]
    rows = df.where(col(fold).between(0, folds - 1)).select(col(fold).cast("int").alias("fold"), F.array(*base).alias("base"), F.array(*extra).alias("extra") if extra else F.array().cast("array<double>").alias("extra"))
    means = rows.agg(*[F.avg(F.get("base", F.lit(i))) for i in range(len(base))], *[F.avg(F.get("extra", F.lit(i))) for i in range(len(extra))]).first()
    shift = np.array([float(m or 0) for m in means])
    d, c = len(base) + 1, len(extra)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_sum, x_sum, s_sum = np.zeros((folds, d, d)), np.zeros((folds, c, d)), np.zeros((folds, c))
        for batch in batches:
            n = batch.num_rows
            f = batch.column(0).to_numpy()
            b = np.ones((n, d))
            b[:, 1:] = batch.column(1).flatten().to_numpy().reshape(n, d - 1) - shift[: d - 1]
            x = batch.column(2).flatten().to_numpy().reshape(n, c) - shift[d - 1 :]
            for k in np.unique(f):
                own, new = b[f == k], x[f == k]
                b_sum[k] += own.T @ own
                x_sum[k] += new.T @ own
                s_sum[k] += (new * new).sum(0)
        kinds = [("b", b_sum.reshape(folds * d, d)), ("x", x_sum.reshape(folds * c, d)), ("s", s_sum.reshape(folds, c))]
        for kind, table in kinds:
            at = np.argwhere(table != 0)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(table[at[:, 0], at[:, 1]])], names=["kind", "i", "j", "v"])

    cells = rows.mapInArrow(summed, "kind string, i long, j long, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v"))
    out = {"b": np.zeros((folds * d, d)), "x": np.zeros((folds * c, d)), "s": np.zeros((folds, c))}
    for r in cells.collect():
        out[r.kind][r.i, r.j] = r.v
    return FoldMoments(out["b"].reshape(folds, d, d), out["x"].reshape(folds, c, d), out["s"], shift[: d - 1], shift[d - 1 :])


def _bordered(m: FoldMoments, candidate: int | None) -> np.ndarray:
    """By fold, products of (1, features[, candidate], label)."""
    if candidate is None:
        return m.base
    folds, d, _ = m.base.shape
    out = np.zeros((folds, d + 1, d + 1))
    keep = [*range(d - 1), d]
    out[np.ix_(range(folds), keep, keep)] = m.base
    out[:, d - 1, keep] = out[:, keep, d - 1] = m.cross[:, candidate]
    out[:, d - 1, d - 1] = m.squares[:, candidate]
    return out


def _solve(p: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge with a free bias from products of (1, columns, label)."""
    n, sums = p[0, 0], p[0, 1:]
    centred = p[1:, 1:] - np.outer(sums, sums) / n
    f = len(sums) - 1
    w = np.linalg.solve(centred[:f, :f] + alpha * np.eye(f), centred[:f, f]) if f else np.zeros(0)
    return w, float(sums[f] - w @ sums[:f]) / n


def ridge_scores(m: FoldMoments, alpha: float = 1.0, candidate: int | None = None) -> list[dict[str, float | None]]:
    """r2, rmse and mse of each fold under the ridge of all other folds; None where a fold has no rows or no spread."""
    p = _bordered(m, candidate)
    whole = p.sum(0)
    out = []
    for own in p:
        rest = whole - own
        if own[0, 0] < 1 or rest[0, 0] < 1:
            out.append({"r2": None, "rmse": None, "mse": None})
            continue
        w, bias = _solve(rest, alpha)
        # the error is (-bias, -w, 1) applied to (1, columns, label)
        e = np.concatenate([[-bias], -w, [1.0]])
        mse = max(float(e @ own @ e / own[0, 0]), 0.0)
        spread = float(own[-1, -1] / own[0, 0] - (own[0, -1] / own[0, 0]) ** 2)
        out.append({"r2": 1 - mse / spread if spread > 0 else None, "rmse": mse**0.5, "mse": mse})
    return out


def _mean(scores: list[dict], metric: str) -> float:
    values = [s[metric] for s in scores if s[metric] is not None]
    return float(np.mean(values)) if values else float("nan")


def ridge_cv(df: DataFrame, features: list[str], label: str, fold: str, folds: int, alpha: float = 1.0) -> dict[str, tuple[float, float]]:
    """Mean and population deviation over the folds of r2, rmse and mse, in one pass for the means and one for the moments."""
    scores = ridge_scores(fold_moments(df, features, label, fold, folds), alpha)
    out = {}
    for metric in ("r2", "rmse", "mse"):
        values = [s[metric] for s in scores if s[metric] is not None]
        out[metric] = (float(np.mean(values)), float(np.std(values))) if values else (float("nan"), float("nan"))
    return out


def candidate_lifts(df: DataFrame, features: list[str], label: str, fold: str, folds: int, candidates: dict[str, Column], alpha: float = 1.0, metric: str = "r2") -> dict[str, float]:
    """By how much each candidate column alone, added to the features, raises the cross-validated r2 (or lowers an error)."""
    m = fold_moments(df, features, label, fold, folds, candidates)
    base = _mean(ridge_scores(m, alpha), metric)
    sign = 1 if metric == "r2" else -1
    return {n: sign * (_mean(ridge_scores(m, alpha, i), metric) - base) for i, n in enumerate(candidates)}
