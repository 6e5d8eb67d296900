"""Learned dense columns for categories: a truncated SVD of their co-occurrence, and a denoising bottleneck in closed form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import discard, written
from ..schema import col

#: Further vectors of the block besides those wanted, and rounds of the power iteration.
OVERSAMPLE, ROUNDS = 6, 5


def _token(name: str, i: int) -> Column:
    """A category as one string: the column's number, and the value or a mark for null."""
    value = col(name).cast("string")
    return F.when(value.isNull(), F.lit(f"{i}~")).otherwise(F.concat(F.lit(f"{i}="), value))


def co_occurrence(df: DataFrame, columns: list[str]) -> DataFrame:
    """(u, v, n): rows in which two categories of different columns stand together, both ways round."""
    tokens = df.select(F.array(*[_token(c, i) for i, c in enumerate(columns)]).alias("t"))
    pairs = F.array(*[F.struct(F.get("t", F.lit(i)).alias("u"), F.get("t", F.lit(j)).alias("v")) for i in range(len(columns)) for j in range(len(columns)) if i != j])
    return tokens.select(F.explode(pairs).alias("p")).groupBy("p.u", "p.v").agg(F.count(F.lit(1)).alias("n"))


def normalised(counts: DataFrame) -> DataFrame:
    """(u, v, w): counts over the square root of both categories' totals, so that frequent ones don't outweigh all else."""
    totals = counts.groupBy("u").agg(F.sum("n").alias("d"))
    both = counts.join(totals, "u").join(totals.select(F.col("u").alias("v"), F.col("d").alias("e")), "v")
    return both.select("u", "v", (F.col("n") / F.sqrt(F.col("d").cast("double") * F.col("e"))).alias("w"))


def _combined(vector: str, by: np.ndarray) -> Column:
    """The vector times a matrix, as an array."""
    return F.array(*[sum((F.get(vector, F.lit(i)) * float(by[i, j]) for i in range(by.shape[0])), F.lit(0.0)) for j in range(by.shape[1])]).cast("array<double>")


def _gram(df: DataFrame, a: str, b: str, k: int) -> np.ndarray:
    """The k x k sums of products of two array columns, which are symmetric."""
    row = df.agg(*[F.sum(F.get(a, F.lit(i)) * F.get(b, F.lit(j))).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def top_vectors(edges: DataFrame, k: int, rounds: int = ROUNDS, oversample: int = OVERSAMPLE) -> tuple[DataFrame, list[float]]:
    """((node, vector), values): the ``k`` eigenvectors of largest absolute eigenvalue of a symmetric sparse matrix (u, v, w).

    A block of pseudo-random vectors is multiplied by the matrix, a join and an aggregate, and made orthonormal by its Gram
    matrix, which is all that comes to the driver.  In the end the matrix is solved within the block's space.  Signs are
    such that a vector's sum is not negative.  A matrix of lower rank has fewer vectors.
    """
    edges = edges.cache()
    block = k + oversample
    try:
        nodes = edges.select(F.col("u").alias("node")).distinct()
        start = F.array(*[F.xxhash64(F.lit(i), "node") / 2.0**63 for i in range(block)])
        q, width = _orthonormal(nodes.select("node", start.alias("q")), block)
        for _ in range(rounds if width else 0):
            last = q
            q, width = _orthonormal(_multiplied(edges, last, width), width)
            discard(last)
        if not width:
            return q.select("node", F.col("q").alias("vector")), []
        image = _multiplied(edges, q, width).withColumnRenamed("q", "mq")
        values, vectors = np.linalg.eigh(_gram(q.join(image, "node", "left"), "q", "mq", width))
        order = np.argsort(-np.abs(values), kind="stable")[:k]
        order = order[np.abs(values[order]) > 1e-9]
        sums = q.agg(*[F.sum(F.get("q", F.lit(i))) for i in range(width)]).first()
        turned = vectors[:, order] * np.where(np.array([s or 0.0 for s in sums]) @ vectors[:, order] < 0, -1.0, 1.0) if len(order) else np.zeros((width, 0))
        found = q.select("node", (_combined("q", turned) if len(order) else F.array().cast("array<double>")).alias("vector"))
        return found, values[order].tolist()
    finally:
        edges.unpersist()


def _multiplied(edges: DataFrame, q: DataFrame, width: int) -> DataFrame:
    joined = edges.join(q, edges.v == q.node).groupBy("u").agg(*[F.sum(F.col("w") * F.get("q", F.lit(i))).alias(f"y{i}") for i in range(width)])
    return joined.select(F.col("u").alias("node"), F.array(*[F.col(f"y{i}") for i in range(width)]).alias("q"))


def _orthonormal(y: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The block with orthonormal columns, and how many: directions that it does not have are left out."""
    y = y.persist()
    values, vectors = np.linalg.eigh(_gram(y, "q", "q", width))
    real = values > max(values[-1], 0.0) * 1e-13 if width else np.zeros(0, bool)
    by = vectors[:, real] / np.sqrt(values[real])
    q = written(y.select("node", _combined("q", by).alias("q")))
    y.unpersist()
    return q, int(real.sum())


def fit_embeddings(df: DataFrame, columns: list[str], dim: int = 8, context: list[str] | None = None) -> dict[str, DataFrame]:
    """A table (value, emb_0, ...) for each of ``columns``: vectors of its categories, from what they stand together with.

    ``context`` are further columns, the target among them, that shape the vectors without getting any.  Rows are those to learn
    from; null is a category.  Columns beyond the rank are 0, and so are all of a lone column without context.
    """
    names = [*columns, *[c for c in context or [] if c not in columns]]
    if len(names) < 2:
        found, size = None, 0
    else:
        found, values = top_vectors(normalised(co_occurrence(df, names)), dim)
        size = len(values)
        found = found.persist()
        scale = [abs(v) ** 0.5 for v in values]
    out = {}
    for i, c in enumerate(columns):
        if found is None:
            out[c] = df.select(col(c).cast("string").alias("value")).distinct().select("value", *[F.lit(0.0).alias(f"emb_{j}") for j in range(dim)])
            continue
        own = found.where(F.col("node").startswith(f"{i}=") | (F.col("node") == f"{i}~"))
        value = F.when(F.col("node") == f"{i}~", F.lit(None).cast("string")).otherwise(F.substring("node", len(str(i)) + 2, 2**30))
        out[c] = own.select(value.alias("value"), *[(F.get("vector", F.lit(j)) * scale[j] if j < size else F.lit(0.0)).alias(f"emb_{j}") for j in range(dim)])
    return out


# ---- denoising ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Denoiser:
    """A linear bottleneck over one-hot categories: ``values`` by column (others share a last place), means and encoder."""

    columns: list[str]
    values: list[list[str]]
    mean: list[float]
    encoder: list[list[float]]

    def encode(self) -> Column:
        """The bottleneck of a row, an array."""
        places, at = [], 0
        for c, known in zip(self.columns, self.values, strict=True):
            found = F.array_position(F.array(*map(F.lit, known)), col(c).cast("string")) if known else F.lit(0)
            place = F.coalesce(F.when(found > 0, found.cast("int") - 1), F.lit(len(known)))
            places.append((place, at))
            at += len(known) + 1
        base = np.array(self.encoder) @ np.array(self.mean) if self.encoder else np.zeros(0)
        rows = [F.array(*[F.lit(float(v)) for v in e]) for e in self.encoder]
        return F.array(*[sum((F.get(r, p + a) for p, a in places), F.lit(-float(b))) for r, b in zip(rows, base, strict=True)])


def swapped_moments(second: np.ndarray, mean: np.ndarray, block: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """(E[x x~'], E[x~ x~']) when every block of x~ is, with probability ``noise``, drawn anew from its marginal, by itself.

    ``second`` is E[x x'], ``mean`` E[x], ``block`` the block of each place.  Within a block the second moments of a drawn block
    are those of the block itself; between blocks a drawn one is independent.
    """
    outer, keep = np.outer(mean, mean), 1 - noise
    mixed = keep * second + noise * outer
    both = np.where(block[:, None] == block[None, :], second, keep**2 * second + (1 - keep**2) * outer)
    return mixed, both


def one_hot_moments(df: DataFrame, columns: list[str], values: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(E[x x'], E[x], block) of one-hot rows from the counts of category pairs: one aggregate, at most places squared rows."""
    block = np.array([i for i, v in enumerate(values) for _ in range(len(v) + 1)])
    first = np.concatenate([[0], np.cumsum([len(v) + 1 for v in values])])
    place = [F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, v)), col(c).cast("string")), F.lit(0)), F.lit(len(v) + 1)) - 1 + int(a) if v else F.lit(int(a)).cast("long") for c, v, a in zip(columns, values, first, strict=False)]
    pairs = F.array(*[F.struct(place[i].alias("i"), place[j].alias("j")) for i in range(len(columns)) for j in range(i, len(columns))])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.j").agg(F.count(F.lit(1)).alias("n")).collect()
    second = np.zeros((len(block), len(block)))
    for r in counts:
        second[r.i, r.j] = second[r.j, r.i] = r.n
    n = max(sum(r.n for r in counts if r.i == r.j and r.i < first[1]), 1)
    second /= n
    return second, np.diag(second).copy(), block


def fit_denoiser(df: DataFrame, columns: list[str], latent: int = 16, noise: float = 0.2, most: int = 64, ridge: float = 1e-6) -> Denoiser:
    """The bottleneck of ``latent`` places that best restores rows from rows with swap noise, over all possible noise at once.

    Instead of drawing noise, its expected moments are put into the least-squares problem, which is solved for a map of
    that rank.  Each column's ``most`` commonest values have places of their own, and all others one together.
    """
    kinds = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p")).select("p.*").where("v is not null")
    counted = kinds.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    held = {r.c: [x["v"] for x in r.best] for r in _commonest(counted, most).collect()}
    values = [held.get(i, []) for i in range(len(columns))]
    second, mean, block = one_hot_moments(df, columns, values)
    second, centre = second - np.outer(mean, mean), np.zeros(len(mean))
    mixed, both = swapped_moments(second, centre, block, noise)
    restore = np.linalg.solve(both + ridge * np.eye(len(mean)), mixed.T).T
    weight, axes = np.linalg.eigh(restore @ both @ restore.T)
    axes = axes[:, np.argsort(-weight, kind="stable")[:latent]]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Denoiser(list(columns), values, mean.tolist(), (axes.T @ restore).tolist())


def _commonest(counted: DataFrame, most: int) -> DataFrame:
    """(c, best): each column's ``most`` commonest values, by a window that keeps no more than those."""
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    top = counted.withColumn("r", rank).where(F.col("r") <= most)
    return top.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("best"))
