"""Gradient-boosted trees for any number of classes, on histograms.

Features are cut into bins once, and rows of equal bins and label are counted together: a tree sees nothing else of them.
Each level of a round's trees, one for each class, is one aggregate of gradient and hessian sums by (class, node, feature,
bin); the best split of every node is chosen in Spark, and only the splits come to the driver.  A fitted model is
expressions over its trees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import discard, written
from ..schema import col
from .splits import range_of

#: Rounds after which the scores so far are written and their plan ends.
CUT = 8
_TREE = "array<struct<feature: array<int>, bin: array<int>, value: array<double>>>"


@dataclass(frozen=True)
class Boosted:
    """Trees by round and class over binned features: class k's score is its prior plus the values of its trees.

    A tree is complete: node i has the children 2 i + 1 and 2 i + 2.  A row whose bin of ``feature`` is at most ``bin`` goes
    left; a feature of -1 ends the way, and ``value`` is the node's.
    """

    edges: list[list[float]]
    prior: list[float]
    rounds: list[list[dict]]

    def probability(self, features: list[Column]) -> Column:
        """The classes' probabilities of rows with these features."""
        bins = F.array(*[range_of(x, e) for x, e in zip(features, self.edges, strict=True)])

        def score(k: int, bins: Column) -> Column:
            own = F.transform(_trees([trees[k] for trees in self.rounds]), lambda t: _value(t, bins, self.depth))
            return F.aggregate(own, F.lit(self.prior[k]), lambda a, x: a + x)

        return softmax(_let(bins, lambda b: F.array(*[score(k, b) for k in range(len(self.prior))])))

    @property
    def depth(self) -> int:
        return (len(self.rounds[0][0]["feature"]) + 1).bit_length() - 2 if self.rounds else 0


def _trees(trees: list[dict]) -> Column:
    """The trees as a literal."""
    return F.from_json(F.lit(json.dumps(trees)), _TREE)


def _leaf(tree: Column, bins: Column, depth: int) -> Column:
    """The node in which rows of these bins end, after ``depth`` steps at most."""

    def down(node: Column, _: Column) -> Column:
        feature = F.get(tree["feature"], node)
        left = F.get(bins, feature) <= F.get(tree["bin"], node)
        return F.when(F.coalesce(feature, F.lit(-1)) < 0, node).otherwise(2 * node + F.when(left, 1).otherwise(2))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down) if depth else F.lit(0)


def _value(tree: Column, bins: Column, depth: int) -> Column:
    return F.get(tree["value"], _leaf(tree, bins, depth))


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the value, which is computed once however often it stands there."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    parts = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return _let(scores, lambda s: _let(parts(s), lambda p: _let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total))))


def bin_edges(df: DataFrame, features: list[Column], bins: int) -> list[list[float]]:
    """Up to ``bins`` - 1 ascending inner edges of each feature, near its quantiles; one pass of bounded sketches."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(x, shares, 100 * bins).alias(f"q{i}") for i, x in enumerate(features)], *[F.min(x).alias(f"m{i}") for i, x in enumerate(features)]).first()
    # an edge opens its bin, so one at the minimum would part nothing
    return [sorted({v for v in row[f"q{i}"] or [] if v > row[f"m{i}"]}) for i in range(len(features))]


def fit_boosted(df: DataFrame, features: list[Column], label: str, classes: int, trees: int = 20, depth: int = 4, step: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 1e-3) -> Boosted:
    """Softmax boosting of ``trees`` rounds with second-order leaf values.

    ``label`` holds 0 to ``classes`` - 1; rows without one are left out.  ``ridge`` is added to a node's hessian, and a child
    has at least a hessian of ``least``.  Among equal gains the first feature and bin is taken.  Without rows, or where nothing
    is gained, the model is the prior.
    """
    known = df.where(col(label).isNotNull())
    edges = bin_edges(known, features, bins)
    binned = known.select(col(label).cast("int").alias("y"), F.array(*[range_of(x, e).cast("int") for x, e in zip(features, edges, strict=True)]).alias("bins"))
    rows = written(binned.groupBy("y", "bins").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if unknown := [y for y in sizes if not 0 <= y < classes]:
        raise ValueError(f"labels {sorted(unknown)[:5]} are not 0 to {classes - 1}")
    total = sum(sizes.values())
    prior = [math.log((sizes.get(k, 0) + 1e-9) / max(total, 1)) for k in range(classes)]
    model = Boosted(edges, prior, [])
    if not total or not features:
        return model
    scored = rows.withColumn("scores", F.array(*map(F.lit, prior)))
    held: list[DataFrame] = []
    try:
        for i in range(trees):
            now = with_slopes(scored).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(now)
            grown = _grow(now, classes, depth, ridge, least, step)
            if all(t["feature"][0] < 0 for t in grown):
                break
            model.rounds.append(grown)
            added = F.transform(_trees(grown), lambda t: _value(t, F.col("bins"), depth))
            scored = now.select("y", "bins", "n", F.zip_with("scores", added, lambda s, v: s + v).alias("scores"))
            if (i + 1) % CUT == 0:
                scored, last = written(scored), rows
                for f in held:
                    f.unpersist()
                discard(last)
                rows, held = scored, []
    finally:
        for f in held:
            f.unpersist()
        discard(rows)
    return model


def with_slopes(rows: DataFrame) -> DataFrame:
    """Add ``slopes``: each class's gradient and hessian of the loss, from ``y``, the number of rows ``n`` and the ``scores``."""
    one = lambda q, k: F.struct((F.col("n") * (q - (F.col("y") == k).cast("double"))).alias("g"), (F.col("n") * F.greatest(q * (1 - q), F.lit(1e-16))).alias("h"))
    return rows.withColumn("p", softmax(F.col("scores"))).withColumn("slopes", F.transform("p", one)).select("y", "bins", "n", "scores", "slopes")


def histogram(rows: DataFrame, trees: list[dict], level: int) -> DataFrame:
    """(class, node, feature, bin, g, h): sums of the slopes of rows by their node at a level of each class's tree."""
    leaf = F.transform(_trees(trees), lambda t: _leaf(t, F.col("bins"), level))
    each = F.transform(leaf, lambda node, k: F.struct(k.alias("class"), node.alias("node"), F.get("slopes", k)["g"].alias("g"), F.get("slopes", k)["h"].alias("h")))
    # nodes of this level only: others have ended
    live = rows.select("bins", F.explode(F.filter(each, lambda x: x["node"] >= 2**level - 1)).alias("x")).select("bins", "x.*")
    return live.select("class", "node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _grow(rows: DataFrame, classes: int, depth: int, ridge: float, least: float, step: float) -> list[dict]:
    """A tree for each class, level by level."""
    size = 2 ** (depth + 1) - 1
    grown = [{"feature": [-1] * size, "bin": [0] * size, "value": [0.0] * size} for _ in range(classes)]
    for level in range(depth):
        cells = histogram(rows, grown, level)
        within = Window.partitionBy("class", "node", "feature")
        upto = within.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = cells.withColumns({"gl": F.sum("g").over(upto), "hl": F.sum("h").over(upto), "ga": F.sum("g").over(within), "ha": F.sum("h").over(within)})
        gr, hr = F.col("ga") - F.col("gl"), F.col("ha") - F.col("hl")
        part = lambda g, h: g * g / (h + ridge)
        gain = part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("ga"), F.col("ha"))
        ok = (F.col("hl") >= least) & (hr >= least) & (gain > 1e-9)
        order = F.struct(-gain, "feature", "bin")
        best = sums.groupBy("class", "node").agg(F.min(F.when(ok, F.struct(order.alias("order"), "gl", "hl", "ga", "ha"))).alias("s"), F.max("ga").alias("ga"), F.max("ha").alias("ha")).collect()
        for r in best:
            tree = grown[r["class"]]
            if level == 0:
                tree["value"][0] = -step * r.ga / (r.ha + ridge)
            if r.s is None:
                continue
            i = r.node
            tree["feature"][i], tree["bin"][i] = r.s["order"]["feature"], r.s["order"]["bin"]
            for child, g, h in ((2 * i + 1, r.s.gl, r.s.hl), (2 * i + 2, r.s.ga - r.s.gl, r.s.ha - r.s.hl)):
                tree["value"][child] = -step * g / (h + ridge)
        if not any(r.s for r in best):
            break
    return grown
