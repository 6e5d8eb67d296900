"""Models as fit functions, cross-validation over stored folds, calibration, and the choice of models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import col
from . import metrics as M
from .boosting import Boosted, fit_boosted


class ModelError(ValueError):
    """A model or metric that doesn't fit the data."""


#: A fitted model: adds ``prediction`` and, for a classifier, ``probability`` (an array over classes) to a frame.
Scorer = Callable[[DataFrame], DataFrame]
#: Fit: (frame, features, label) -> Scorer.
Fit = Callable[[DataFrame, list[str], str], Scorer]


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as a vector; null and NaN count as 0 (impute before)."""
    numbers = [_number(c).alias(f"_f{i}") for i, c in enumerate(features)]
    wide = df.select("*", *numbers)
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(wide).drop(*[f"_f{i}" for i in range(len(features))])


@dataclass(frozen=True)
class Fitted:
    """A fitted model as a Scorer that can be saved: plain numbers, boosted trees, or an MLlib model over the assembled features."""

    features: list[str]
    constant: float | None = None
    probability: list[float] | None = None
    weights: list[float] | None = None
    model: Model | None = None
    boosted: Boosted | None = None

    def __call__(self, new: DataFrame) -> DataFrame:
        if self.boosted is not None:
            out = new.withColumn("probability", self.boosted.probability([_number(c) for c in self.features]))
            return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
        if self.model is not None:
            out = self.model.transform(assembled(new, self.features))
            if "probability" in out.columns:
                out = out.withColumn("probability", vector_to_array("probability"))
            return out.drop("_x", "_z", "rawPrediction")
        line: Column = F.lit(self.constant)
        for w, c in zip(self.weights or [], self.features, strict=False):
            line = line + F.lit(w) * _number(c)
        added = {"prediction": line}
        if self.probability is not None:
            added["probability"] = F.array(*map(F.lit, self.probability))
        return new.withColumns(added)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write to a folder of any store that Spark reaches."""
        plain = {"features": self.features, "constant": self.constant, "probability": self.probability, "weights": self.weights, "boosted": self.boosted and asdict(self.boosted), "mllib": self.model is not None}
        if self.model is not None:
            PipelineModel([self.model]).write().overwrite().save(f"{path}/mllib")
        spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Fitted | Calibrated:
    plain = json.loads(spark.read.text(f"{path}/model").first().value)
    if "maps" in plain:
        return Calibrated(plain["method"], [(load_model(spark, f"{path}/member-{i}"), m) for i, m in enumerate(plain["maps"])])
    model = PipelineModel.load(f"{path}/mllib") if plain.pop("mllib") else None
    boosted = plain.pop("boosted", None)
    return Fitted(**plain, model=model, boosted=boosted and Boosted(**boosted))


def _number(name: str) -> Column:
    return F.coalesce(F.nanvl(col(name).cast("double"), F.lit(0.0)), F.lit(0.0))


def _ml(estimator: Callable[[DataFrame, str], Model]) -> Fit:
    return lambda df, features, label: Fitted(features, model=estimator(assembled(df, features), label))


def naive(classes: int | None = None) -> Fit:
    """The mean of a float target, else the most frequent class (the smallest of equal ones) with certainty.

    Without ``classes`` there are as many as the training rows show.
    """

    def fit(df: DataFrame, features: list[str], label: str) -> Scorer:
        if dict(df.dtypes)[label] in ("double", "float"):
            mean = df.agg(F.avg(col(label))).first()[0]
            return Fitted(features, constant=mean)
        counts = df.where(col(label).isNotNull()).groupBy(col(label).alias("y")).count().orderBy(F.desc("count"), "y").collect()
        top, seen = counts[0].y, max(int(r.y) for r in counts) + 1
        return Fitted(features, constant=float(top), probability=[float(k == int(top)) for k in range(classes or seen)])

    return fit


def logistic(c: float = 1.0, scaled: bool = False, max_iter: int = 100) -> Fit:
    """L2 logistic regression with an unpenalised intercept; the penalty is that of ``c`` over the sum of losses."""

    def estimate(x: DataFrame, label: str):
        n = x.count()
        lr = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
        if not scaled:
            return lr.fit(x)
        return Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_z", withMean=True), lr.setFeaturesCol("_z")]).fit(x)

    return _ml(estimate)


def ridge(alpha: float = 1.0) -> Fit:
    """Ridge with an unpenalised intercept by its normal equations: one aggregate of moments, solved on the driver."""

    def fit(df: DataFrame, features: list[str], label: str) -> Scorer:
        names = [*features, label]
        values = [_number(c) for c in names]
        d = len(names)
        means = df.agg(*[F.avg(v) for v in values]).first()
        centred = [v - F.lit(m or 0.0) for v, m in zip(values, means, strict=True)]
        cells = [(i, j) for i in range(d) for j in range(i, d)]
        sums = df.agg(*[F.sum(centred[i] * centred[j]) for i, j in cells]).first()
        gram = np.zeros((d, d))
        for (i, j), s in zip(cells, sums, strict=True):
            gram[i, j] = gram[j, i] = s or 0.0
        w = np.linalg.solve(gram[:-1, :-1] + alpha * np.eye(d - 1), gram[:-1, -1]) if d > 1 else np.zeros(0)
        bias = (means[d - 1] or 0.0) - float(sum(a * (m or 0.0) for a, m in zip(w, means, strict=False)))
        return Fitted(features, constant=bias, weights=w.tolist())

    fit.alpha = alpha  # by which a fit is known that sums of products can stand in for
    return fit


def gbt(task: str, classes: int = 2, trees: int = 50, depth: int = 5, step: float = 0.1, seed: int = 42) -> Fit:
    """Gradient-boosted trees: MLlib's for numbers and two classes, for more the histogram trees with a softmax loss."""
    if task == "regression":
        return _ml(lambda x, y: GBTRegressor(featuresCol="_x", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(x))
    one = lambda y: GBTClassifier(featuresCol="_x", labelCol=y, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    if classes <= 2:
        return _ml(lambda x, y: one(y).fit(x))
    return boosted_trees(classes, trees=trees, depth=depth, step=step)


def boosted_trees(classes: int, **settings) -> Fit:
    """Histogram boosting for labels 0 to ``classes`` - 1."""
    return lambda df, features, label: Fitted(features, boosted=fit_boosted(df, [_number(c) for c in features], label, classes, **settings))


def forest(task: str, trees: int = 100, depth: int = 10, seed: int = 42) -> Fit:
    if task == "regression":
        return _ml(lambda x, y: RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(x))
    return _ml(lambda x, y: RandomForestClassifier(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(x))


def perceptron(n_features: int, classes: int, hidden: int = 32, seed: int = 42) -> Fit:
    """A small neural network, in place of deep tabular models that need a GPU."""
    return _ml(lambda x, y: MultilayerPerceptronClassifier(featuresCol="_x", labelCol=y, layers=[n_features, hidden, classes], seed=seed).fit(x))


def network(task: str, classes: int = 2, hidden: int = 32, seed: int = 42) -> Fit:
    """``perceptron`` over as many features as there are."""
    if task == "regression":
        raise ModelError("perceptron is a classifier")
    return lambda df, features, label: perceptron(len(features), classes, hidden, seed)(df, features, label)


#: Models by name: (task, settings) -> Fit.  One canonical name is used everywhere.
FACTORY: dict[str, Callable[..., Fit]] = {
    "naive": lambda task, **o: naive(**o),
    "linear": lambda task, **o: ridge(**o) if task == "regression" else logistic(scaled=True, **o),
    "gbt": lambda task, **o: gbt(task, **o),
    "forest": lambda task, **o: forest(task, **o),
    "perceptron": lambda task, **o: network(task, **o),
}
#: Models that are told the number of classes; the others see it in their rows.
TOLD_CLASSES = {"naive", "gbt", "perceptron"}


def register_model(name: str, build: Callable[..., Fit]) -> None:
    FACTORY[name] = build


def make_model(name: str, task: str, classes: int | None = None, **settings) -> Fit:
    if name not in FACTORY:
        raise ModelError(f"no model {name}; there are {sorted(FACTORY)}")
    if classes is not None and task == "classification" and name in TOLD_CLASSES:
        settings = {"classes": classes, **settings}
    return FACTORY[name](task, **settings)


def select_models(requested: Iterable[str] | None = None) -> list[str]:
    """Baselines first, then the requested models, else the trees; the same at every size."""
    return ["naive", "linear", *[m for m in requested or ("gbt", "forest") if m not in ("naive", "linear")]]


def importance_model(task: str, requested: Iterable[str] | None = None, classes: int | None = None) -> Fit:
    """The model that features are judged by: the first tree model requested, else the linear one."""
    return make_model(next((m for m in requested or () if m in ("gbt", "forest")), "linear"), task, classes)


def with_folds(df: DataFrame, folds: int, seed: int, keys: list[str] | None = None, name: str = "_fold") -> DataFrame:
    """A fold for each row by the seeded hash of its values: no shuffle, equal rows stay together."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), *[col(c) for c in keys or df.columns]), F.lit(folds)).cast("int"))


def measure(scored: DataFrame, label: str, names: Iterable[str], classes: int = 2) -> dict[str, float | None]:
    """Metrics of a frame with ``prediction`` and maybe ``probability``: scored once, all plain averages in one aggregate."""
    names = list(names)
    if unknown := [n for n in names if n not in _FAMILY and n not in M.METRICS]:
        raise ModelError(f"no metric {unknown[0]}")
    if "probability" not in scored.columns and (lacking := [n for n in names if n in ("roc_auc", "log_loss")]):
        raise ModelError(f"{lacking[0]} needs probabilities")
    plugins = [n for n in names if n not in _FAMILY]
    rows = scored if plugins else scored.select(label, *[c for c in ("prediction", "probability") if c in scored.columns])
    rows = rows.persist()
    out: dict[str, float | None] = {}
    try:
        wanted = {_FAMILY[n] for n in names if n in _FAMILY}
        if "error" in wanted:
            out |= M.regression_metrics(rows, label, "prediction").first().asDict()
        if "confusion" in wanted:
            out |= M.classification_metrics(rows, label, "prediction").first().asDict()
        if "log_loss" in names:
            own = F.get("probability", col(label).cast("int"))
            clipped = F.least(F.greatest(own, F.lit(M.EPSILON)), F.lit(1 - M.EPSILON))
            out["log_loss"] = rows.agg(-F.avg(F.log(clipped))).first()[0]
        if "roc_auc" in names and classes > 2:
            out["roc_auc"] = M.roc_auc_ovr(rows, label, "probability", classes)
        elif "roc_auc" in names:
            out["roc_auc"] = M.roc_auc(rows.select(col(label), F.get("probability", F.lit(1)).alias("_s")), label, "_s").first()[0]
        for name in plugins:
            out[name] = M.METRICS[name](rows, label, "prediction").first()[0]
    finally:
        rows.unpersist()
    return {n: out[n] for n in names}


#: Metrics of one aggregate.
_FAMILY = {"rmse": "error", "mae": "error", "r2": "error", "accuracy": "confusion", "f1_macro": "confusion", "log_loss": "loss", "roc_auc": "rank"}


def cross_validate(
    df: DataFrame,
    features: list[str],
    label: str,
    fit: Fit,
    metrics: Iterable[str] = ("roc_auc",),
    folds: int = 5,
    seed: int = 42,
    membership: DataFrame | str | None = None,
    classes: int = 2,
    prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
    workers: int = 4,
    keys: list[str] | None = None,
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each metric over the folds.

    Folds come from ``membership`` (row_id, fold, role) by a join, or from the array of that name in stored rows (no join, and no
    cache), else from the hash of the rows, or of the columns ``keys``.  ``prepare`` is
    fitted on each fold's training rows, so that nothing leaks into validation.  Folds run at once up to ``workers``.
    """
    if membership is None:
        rows = with_folds(df, folds, seed, keys).cache()
        sides = [(rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k)) for k in range(folds)]
    elif isinstance(membership, str):
        rows = df
        numbers = sorted(r[0] for r in df.select(F.inline(col(membership))).select("fold").distinct().collect())
        side = lambda k, role: rows.where(F.exists(col(membership), lambda m: (m["fold"] == k) & (m["role"] == role))).drop("row_id", membership)
        sides = [(side(k, "train"), side(k, "validation")) for k in numbers]
    else:
        rows = df.join(membership.select("row_id", "fold", "role"), "row_id").cache()
        numbers = sorted(r[0] for r in membership.select("fold").distinct().collect())
        sides = [(rows.where((F.col("fold") == k) & (F.col("role") == "train")), rows.where((F.col("fold") == k) & (F.col("role") == "validation"))) for k in numbers]

    def one(pair: tuple[DataFrame, DataFrame]) -> dict[str, float | None]:
        train, valid = pair
        if not prepare:
            return measure(fit(train, features, label)(valid), label, metrics, classes)
        change = prepare(train)
        try:
            return measure(fit(change(train), features, label)(change(valid)), label, metrics, classes)
        finally:
            # what a preparation has cached is of no use to other folds
            release = getattr(getattr(change, "__self__", change), "release", None)
            if release:
                release()

    try:
        if workers > 1:
            with ThreadPoolExecutor(workers) as pool:
                found = list(pool.map(one, sides))
        else:
            found = [one(s) for s in sides]
    finally:
        if not isinstance(membership, str):
            rows.unpersist()
    out = {}
    for m in metrics:
        values = [f[m] for f in found if f[m] is not None]
        out[m] = (float(np.mean(values)), float(np.std(values))) if values else (float("nan"), float("nan"))
    return out


def out_of_fold(df: DataFrame, features: list[str], label: str, fit: Fit, folds: int = 3, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """All rows, each scored by a model of the other folds."""
    rows = with_folds(df, folds, seed, keys or [*features, label])
    parts = [fit(rows.where(F.col("_fold") != k), features, label)(rows.where(F.col("_fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_fold")


@dataclass(frozen=True)
class Calibrator:
    """Maps a score to a probability; the mean of one map for each fold."""

    method: str
    maps: list = field(default_factory=list)

    def apply(self, score: Column) -> Column:
        total = F.lit(0.0)
        for m in self.maps:
            if self.method == "platt":
                a, b = m
                total = total + 1 / (1 + F.exp(-(F.lit(a) * score + F.lit(b))))
            else:
                total = total + _interpolate(score, *m)
        return total / len(self.maps)


def _interpolate(x: Column, at: list[float], value: list[float]) -> Column:
    """A step-free line through the points, constant beyond them."""
    points = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(v).alias("y")) for a, v in zip(at, value, strict=True)])
    below, above = F.filter(points, lambda p: p["x"] <= x), F.filter(points, lambda p: p["x"] > x)
    low, high = F.element_at(below, -1), F.element_at(above, 1)
    inside = low["y"] + (x - low["x"]) / (high["x"] - low["x"]) * (high["y"] - low["y"])
    return F.when(F.size(below) == 0, F.lit(value[0])).when(F.size(above) == 0, F.lit(value[-1])).otherwise(inside)


def fit_calibrator(df: DataFrame, features: list[str], label: str, fit: Fit, method: str = "platt", folds: int = 3, seed: int = 42) -> Calibrator:
    """Platt's sigmoid or an isotonic map for a binary classifier, from out-of-fold scores."""
    if method not in ("platt", "isotonic"):
        raise ModelError(f"no calibration {method}")
    rows = with_folds(df, folds, seed, [*features, label])
    maps = []
    for k in range(folds):
        scored = fit(rows.where(F.col("_fold") != k), features, label)(rows.where(F.col("_fold") == k))
        pairs = scored.select(F.get("probability", F.lit(1)).alias("s"), col(label).cast("double").alias("y"))
        if method == "platt":
            x = VectorAssembler(inputCols=["s"], outputCol="_x").transform(pairs)
            m = LogisticRegression(featuresCol="_x", labelCol="y").fit(x)
            maps.append((float(m.coefficients[0]), float(m.intercept)))
        else:
            m = IsotonicRegression(featuresCol="s", labelCol="y").fit(pairs.withColumn("s", F.round("s", 4)))
            maps.append((m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()))
    return Calibrator(method, maps)


@dataclass(frozen=True)
class Calibrated:
    """An ensemble of models, each with maps from its scores to probabilities, fitted on rows that it did not see.

    Of two classes a member has one map, that of class 1; of more, one for each class against the rest, and what they give is
    made to sum to 1.  The probabilities of the members are averaged.
    """

    method: str
    members: list[tuple[Fitted, list]]

    @property
    def features(self) -> list[str]:
        return self.members[0][0].features

    def __call__(self, new: DataFrame) -> DataFrame:
        out, names = new, []
        for i, (model, maps) in enumerate(self.members):
            names.append(f"_p{i}")
            out = model(out).withColumn(names[-1], _mapped(self.method, maps)).drop("prediction", "probability")
        total = F.col(names[0])
        for n in names[1:]:
            total = F.zip_with(total, F.col(n), lambda a, b: a + b)
        out = out.withColumn("probability", F.transform(total, lambda p: p / len(names))).drop(*names)
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (model, _) in enumerate(self.members):
            model.save(spark, f"{path}/member-{i}")
        plain = {"method": self.method, "maps": [m for _, m in self.members]}
        spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def _mapped(method: str, maps: list) -> Column:
    """The probabilities of one member from its column ``probability``."""

    def one(k: int, m: list) -> Column:
        s = F.get("probability", F.lit(k))
        return 1 / (1 + F.exp(-(F.lit(m[0]) * s + F.lit(m[1])))) if method == "platt" else _interpolate(s, *m)

    if len(maps) == 1:
        p = one(1, maps[0])
        return F.array(1 - p, p)
    each = F.array(*[one(k, m) for k, m in enumerate(maps)])
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.transform(each, lambda p: F.when(total > 0, p / total).otherwise(1 / len(maps)))


def fit_calibrated(df: DataFrame, features: list[str], label: str, fit: Fit, classes: int, method: str = "platt", folds: int = 3, seed: int = 42) -> Calibrated:
    """A member for each fold: the model of the other folds, and maps of its scores on this one.

    ``platt`` is a sigmoid with smoothed targets, ``isotonic`` a monotone map.  Folds come from the rows' hash.
    """
    if method not in ("platt", "isotonic"):
        raise ModelError(f"no calibration {method}")
    rows = with_folds(df, folds, seed, [*features, label])
    own = [1] if classes == 2 else list(range(classes))
    members = []
    for k in range(folds):
        model = fit(rows.where(F.col("_fold") != k), features, label)
        scored = model(rows.where(F.col("_fold") == k)).select("probability", col(label).cast("int").alias("y")).persist()
        try:
            members.append((model, _platt(scored, own) if method == "platt" else [_isotonic(scored, c) for c in own]))
        finally:
            scored.unpersist()
    return Calibrated(method, members)


def _isotonic(scored: DataFrame, k: int) -> list:
    pairs = scored.select(F.round(F.get("probability", F.lit(k)), 4).alias("s"), (F.col("y") == k).cast("double").alias("y"))
    m = IsotonicRegression(featuresCol="s", labelCol="y").fit(pairs)
    return [m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()]


def _platt(scored: DataFrame, classes: list[int]) -> list[list[float]]:
    """Slope and bias of each class's sigmoid by Newton steps; one aggregate a step serves all classes."""
    sizes = scored.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("y") == k).alias(f"n{k}") for k in classes]).first()
    at = np.array([[0.0, float(np.log((sizes[f"n{k}"] + 1) / (sizes.n - sizes[f"n{k}"] + 1)))] for k in classes])
    targets = [((sizes[f"n{k}"] + 1) / (sizes[f"n{k}"] + 2), 1 / (sizes.n - sizes[f"n{k}"] + 2)) for k in classes]

    def sums(at: np.ndarray) -> np.ndarray:
        """By class: loss, gradient (2), hessian (3)."""
        out = []
        for (a, b), k, (high, low) in zip(at.tolist(), classes, targets, strict=True):
            s = F.get("probability", F.lit(k))
            z = F.lit(a) * s + F.lit(b)
            p, t = 1 / (1 + F.exp(-z)), F.when(F.col("y") == k, high).otherwise(low)
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
            w = p * (1 - p)
            out += [F.sum(x) for x in (loss, (p - t) * s, p - t, w * s * s, w * s, w)]
        return np.array([float(v or 0) for v in scored.agg(*[x.alias(f"x{i}") for i, x in enumerate(out)]).first()]).reshape(-1, 6)

    now = sums(at)
    step = np.zeros_like(at)
    for _ in range(50):
        for i, (_, ga, gb, haa, hab, hbb) in enumerate(now):
            step[i] = np.linalg.solve([[haa + 1e-9, hab], [hab, hbb + 1e-9]], [ga, gb])
        if np.abs(step).max() < 1e-8:
            break
        share = np.ones((len(at), 1))
        for _ in range(30):
            then = sums(at - share * step)
            worse = then[:, 0] > now[:, 0] + 1e-12 * np.abs(now[:, 0])
            if not worse.any():
                break
            share[worse] /= 2
        at, now = at - share * step, then
    return at.tolist()
