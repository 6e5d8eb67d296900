"""The public facade: load, check, prepare, compare, train, report."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import drift, splits
from .operators.audit import drop_noise, label_noise, leakage_audit
from .operators.embedding import fit_embeddings
from .operators.features import augment, engineer, fit_frequency_encoding, interaction_candidates
from .operators.identity import frame_digest, with_row_ids
from .operators.labels import fit_labels
from .operators.metrics import lower_is_better
from .operators.models import cross_validate, fit_calibrated, importance_model, make_model, select_models
from .operators.prep import fit_prep
from .operators.profile import high_cardinality, preflight
from .plans import lake, reporting
from .plans.bundle import Predictor, export_bundle, load_bundle
from .schema import categorical_columns, col, numeric_columns
from .sources.events import EventLog, read_events
from .sources.tables import load_data


#: Split kinds of a run: (rows with row_id, config) -> membership.
SPLITS = {
    "kfold": lambda rows, c: splits.kfold(rows, c.folds, c.seed),
    "stratified": lambda rows, c: splits.stratified(rows, c.target, c.folds, c.seed),
    "group": lambda rows, c: splits.group_kfold(rows, c.column, c.folds),
    "time": lambda rows, c: splits.time_split(rows, c.column, c.folds),
}


def exact_sample(df: DataFrame, share: float, seed: int) -> DataFrame:
    """``share`` of the rows, rounded, but one at least: those first in the order of a seeded hash of content and copy."""
    rows = with_row_ids(df, "_id")
    n = rows.count()
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "_id"), 256)
    return splits.positions(rows, [order], "_at", hexed=True).where(F.col("_at") < max(1, round(share * n))).drop("_id", "_at")


def lifts(scores: dict[str, float], baseline: dict[str, float]) -> dict[str, float]:
    """Relative gain over the baseline of each metric that both have, in the metric's direction."""
    out = {}
    for m, v in scores.items():
        if baseline.get(m):
            gain = (v - baseline[m]) / abs(baseline[m])
            out[m] = -gain if lower_is_better(m) else gain
    return out


@dataclass(frozen=True)
class ExperimentConfig:
    target: str
    task: str = "classification"
    metrics: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    folds: int = 5
    seed: int = 42
    ignore: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    workers: int = 4
    #: Features: as prepared (``none``), with interactions that help, pruned (``afe``), or with dense columns in place of
    #: strings of many values (``embedding``).
    strategy: str = "none"
    #: Learned dense columns of such a string.
    dim: int = 4
    #: Folds: by row hash, or a stored kind of split; ``column`` is that of a group or time split.
    split: str = "hash"
    column: str | None = None
    calibration: str | None = None
    #: Least label quality of the rows to train on; loss of score under permutation from which on a feature is named a leak.
    noise: float | None = None
    leakage: float | None = None
    #: Share of the rows to run on, exactly that many; whether an equal run goes on.
    share: float = 1.0
    resume: bool = False

    def __post_init__(self):
        for value, known in ((self.task, ("classification", "regression")), (self.strategy, ("none", "afe", "embedding")), (self.split, ("hash", *SPLITS))):
            if value not in known:
                raise ValueError(f"{value} is none of {known}")
        if not 0 < self.share <= 1:
            raise ValueError("share must be over 0 and at most 1")

    @property
    def key(self) -> dict:
        """What makes two runs equal."""
        return {k: v for k, v in sorted(asdict(self).items()) if k not in ("workers", "resume")}

    def membership(self, rows: DataFrame) -> DataFrame:
        """The stored split of rows with a ``row_id``."""
        return SPLITS[self.split](rows, self)

    @property
    def measured(self) -> tuple[str, ...]:
        return self.metrics or (("r2", "rmse", "mae") if self.task == "regression" else ("roc_auc", "f1_macro", "accuracy"))


class ExperimentSession:
    """``workspace`` holds the event log, the registry and the lake."""

    def __init__(self, spark: SparkSession, workspace: str):
        self.spark, self.workspace = spark, Path(workspace)
        self.log = EventLog(str(self.workspace / "events.jsonl"))
        self.registry = reporting.Registry(str(self.workspace / "registry.json"))

    def init(self, reset_registry: bool = False) -> str:
        """Make the workspace's folders; what is there stays, but for a registry that is to be reset."""
        for folder in ("artifacts", "lake", "docs"):
            (self.workspace / folder).mkdir(parents=True, exist_ok=True)
        if reset_registry or not self.registry.path.exists():
            self.registry.reset()
        return str(self.workspace)

    def publish(self, folder: str | None = None, limit: int = 100) -> str:
        """Write the published documents as JSON files, each replaced in one step; runs and products, at most ``limit`` of the newest."""
        out = Path(folder) if folder else self.workspace / "docs"
        out.mkdir(parents=True, exist_ok=True)
        found = reporting.docs_json(self.events(), self.registry.load(), limit) if self.log.files() else {}
        found["catalog"] = json.dumps(lake.Lake(self.spark, str(self.workspace / "lake")).products(limit=limit), sort_keys=True)
        for name, text in found.items():
            staging = out / f".{name}.json"
            staging.write_text(text)
            staging.replace(out / f"{name}.json")
        return str(out)

    def load(self, path: str) -> DataFrame:
        return load_data(self.spark, path)

    def plan(self, config: ExperimentConfig, df: DataFrame) -> dict:
        return {"config": config.__dict__, "rows": (n := df.count()), "models": select_models(config.models), "issues": preflight(df, config.target, config.task, list(config.ignore), folds=config.folds)}

    def run(self, config: ExperimentConfig, df: DataFrame) -> DataFrame:
        """Cross-validate every model, fit it on all rows, calibrate, save and log it; the leaderboard of this run.

        The classes of a classification may be of any type and number; predictions are its values again.  The lift of a model
        is over the naive baseline of the same run, none if that failed.  Preparation is fitted on the training rows of each fold.  A model that fails is logged and left out.  With
        ``resume`` a run of an equal configuration and equal data goes on: models it completed are not run again.
        """
        if config.share < 1:
            df = exact_sample(df, config.share, config.seed)
        digest = frame_digest(df).first()
        rows = digest.n_rows
        run_id = hashlib.sha256(json.dumps([config.key, rows, digest.digest], sort_keys=True).encode()).hexdigest()[:12] if config.resume else uuid.uuid4().hex[:12]
        say = lambda **e: self.log.append({"run_id": run_id, "timestamp": datetime.now(timezone.utc).isoformat(), "task": config.task, "n_rows": rows, **e})
        past = {r.model for r in self.events().where((F.col("run_id") == run_id) & (F.col("event") == "model_completed")).select("model").collect()} if config.resume and self.log.files() else set()
        say(event="experiment_started", config=json.dumps(config.key))
        ignore = list(config.ignore)
        # classes are codes from here on; a row without a class has nothing to learn or to score
        labels = fit_labels(df, config.target) if config.task == "classification" else None
        classes = max(2, len(labels.values)) if labels else None
        df = labels.encode(df) if labels else df.where(col(config.target).isNotNull())
        if config.noise is not None:
            df = self._cleaned(df, config, say)
        dense = [c for c in high_cardinality(df.drop(*ignore), config.target) if c in categorical_columns(df)] if config.strategy == "embedding" else []

        def embed(train: DataFrame) -> dict[str, DataFrame]:
            if not dense:
                return {}
            # frequency (and of one class or a number, its smoothed mean) first, then vectors learned from what stands together
            mean = config.target if config.task == "regression" or classes == 2 else None
            others = [c for c in categorical_columns(train) if c not in (*dense, *ignore, config.target)]
            learned = fit_embeddings(train, dense, config.dim, [*others, *([config.target] if labels else [])])
            plain = {c: fit_frequency_encoding(train, c, mean) for c in dense}
            first = {c: len(t.columns) - 1 for c, t in plain.items()}
            return {c: plain[c].join(learned[c].select(F.col("value").alias("_v"), *[F.col(f"emb_{i}").alias(f"emb_{first[c] + i}") for i in range(config.dim)]), F.col("value").cast("string").eqNullSafe(F.col("_v"))).drop("_v") for c in dense}

        tables = embed(df)
        wide = augment(df, dense, tables)
        prep = fit_prep(wide, config.target, ignore)
        ready = prep.transform(wide)
        features, interactions = [c for c in numeric_columns(ready) if c != config.target], ()
        if config.strategy == "afe":
            fit, metric = importance_model(config.task, config.models, classes), "r2" if config.task == "regression" else "roc_auc"
            wide, features = engineer(ready, features, config.target, fit, metric, seed=config.seed, classes=classes or 2)
            interactions = tuple(i for i in interaction_candidates([c for c in numeric_columns(ready) if c != config.target]) if i.name in features)
        if config.leakage is not None:
            for f in leakage_audit(ready, [c for c in features if c in ready.columns], config.target, config.task, config.leakage, seed=config.seed, classes=classes or 2):
                say(event="leakage_found", config=json.dumps({"feature": f.feature, "baseline": f.baseline, "permuted": f.permuted}))
        keyed = with_row_ids(df) if config.split != "hash" else df
        members = config.membership(keyed) if config.split != "hash" else None

        def prepare(train: DataFrame):
            train = train.drop("_fold", "row_id", "fold", "role")
            found = embed(train)
            learned = fit_prep(augment(train, dense, found), config.target, ignore)

            def apply(new: DataFrame) -> DataFrame:
                out = learned.transform(augment(new, dense, found))
                return out.withColumns({i.name: i.expression for i in interactions}) if interactions else out

            apply.release = learned.release
            return apply

        done, baseline = len(past), self._scores(run_id, "naive") if "naive" in past else {}
        for name in [m for m in select_models(config.models) if m not in past]:
            began = time.time()
            settings = config.settings.get(name, {})
            path = f"{self.workspace}/artifacts/{run_id}/{name}"
            try:
                fit = make_model(name, config.task, classes, **settings)
                scores = cross_validate(keyed, features, config.target, fit, config.measured, config.folds, config.seed, membership=members, classes=classes or 2, prepare=prepare, workers=config.workers)
                wide = ready.withColumns({i.name: i.expression for i in interactions}) if interactions else ready
                if config.calibration and labels and name != "naive":
                    model = fit_calibrated(wide, features, config.target, fit, classes, config.calibration, seed=config.seed)
                else:
                    model = fit(wide, features, config.target)
                export_bundle(self.spark, path, Predictor(prep, model, interactions, embeddings=tables, labels=labels), {"run_id": run_id, "model": name, "target": config.target})
                first = {m: v[0] for m, v in scores.items()}
                if name == "naive":
                    baseline = first
                say(event="model_completed", model=name, cv_scores=first, cv_std={m: v[1] for m, v in scores.items()}, params={k: str(v) for k, v in settings.items()}, lift=lifts(first, baseline), calibration=config.calibration, duration_seconds=time.time() - began, artifact_path=path)
                done += 1
            except Exception as e:
                say(event="model_failed", model=name, error=str(e)[:500])
        if not done:
            raise RuntimeError("every model failed")
        board = self.leaderboard().where(F.col("run_id") == run_id)
        self.registry.update(board)
        return board

    def _scores(self, run_id: str, model: str) -> dict[str, float]:
        """The logged scores of a completed model of a run."""
        found = reporting.dedupe_events(self.events()).where((F.col("run_id") == run_id) & (F.col("model") == model)).select("cv_scores").first()
        return dict(found.cv_scores or {}) if found else {}

    def _cleaned(self, df: DataFrame, config: ExperimentConfig, say) -> DataFrame:
        """Without rows whose label is probably wrong: those under ``noise``; how many is logged, with the first 100 ids."""
        if config.task != "classification":
            return df
        named = with_row_ids(df)
        ready = fit_prep(named, config.target, [*config.ignore, "row_id"]).transform(named.withColumn("_id", F.col("row_id"))).withColumnRenamed("_id", "row_id")
        features = [c for c in numeric_columns(ready) if c != config.target]
        report = label_noise(ready, features, config.target, seed=config.seed)
        if not report.enabled:
            return df
        flagged = report.scores.where("is_issue").orderBy("row_id").limit(100)
        say(event="noise_found", config=json.dumps({"rows": report.n_rows, "issues": report.n_issues, "first": [r.row_id for r in flagged.select("row_id").collect()]}))
        return drop_noise(named, report.scores, config.noise).drop("row_id")

    def predictor(self, artifact: str) -> Predictor:
        """The saved predictor of a completed model, by its logged ``artifact_path``."""
        return load_bundle(self.spark, artifact)

    def export(self, key: str, path: str) -> str:
        """The champion of a registry key as a bundle of its own."""
        entry = self.registry.load()[key]
        return export_bundle(self.spark, path, self.predictor(entry["artifact_path"]), entry)

    def drift_check(self, reference: DataFrame, live: DataFrame, method: str = "ks") -> dict:
        out = drift.detect(reference, live, method)
        self.log.append({"event": "drift_check", "timestamp": datetime.now(timezone.utc).isoformat(), "error": None, "config": method})
        return out

    def events(self) -> DataFrame:
        return read_events(self.spark, self.log.files(), "skip_trailing")

    def leaderboard(self, limit: int | None = None) -> DataFrame:
        return reporting.leaderboard(reporting.with_primary(reporting.dedupe_events(self.events())), limit)

    def promote(self, key: str, entry: dict, force: bool = False) -> bool:
        """Take the entry as champion if it is strictly better; ``force`` takes it in any case."""
        return self.registry.promote(key, entry, force)

    def state(self) -> str:
        return reporting.state_markdown(self.events(), self.registry.load())

    def medallion_run(self, df: DataFrame, target: str, task: str = "classification", **options) -> dict:
        return lake.medallion_run(self.spark, str(self.workspace / "lake"), df, target, task, **options)

