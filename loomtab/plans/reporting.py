"""Leaderboards, champions, run differences and the newest events, from the event log."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import timestamp_or_least
from ..operators.metrics import LOWER_BETTER, METRICS, lower_is_better

#: Metrics that name a run's score, in this order, if none is preferred.
RESOLVE = ("roc_auc", "r2")


def lower_column(metric: Column) -> Column:
    names = sorted(LOWER_BETTER | {m for m in METRICS if lower_is_better(m)})
    return metric.isin(*names)


def with_primary(events: DataFrame, preferred: str | None = None, scores: str = "cv_scores") -> DataFrame:
    """Add ``metric`` and ``score``: the preferred metric, else roc_auc, else r2, else the first by name, else ("score", 0)."""
    names = [*([preferred] if preferred else []), *RESOLVE]
    first = F.element_at(F.array_sort(F.map_keys(scores)), 1)
    metric = F.coalesce(*[F.when(F.map_contains_key(scores, n), F.lit(n)) for n in names], F.when(F.size(F.map_keys(scores)) > 0, first), F.lit("score"))
    named = events.withColumn("metric", F.coalesce(metric, F.lit("score")))
    return named.withColumn("score", F.coalesce(F.try_element_at(scores, F.col("metric")), F.lit(0.0)))


def newest(events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``.  Spark turns the filter into a group limit: each task passes one row of a key on."""
    rest = [c for c in events.columns if c not in keys]
    ranked = events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").select(*keys, *rest)


def dedupe_events(events: DataFrame) -> DataFrame:
    """Of completed runs with equal run, model and artifact the newest."""
    done = events.where(F.col("event") == "model_completed")
    return newest(done, ["run_id", "model", "artifact_path"], [timestamp_or_least(F.col("timestamp")).desc(), F.col("line").desc()])


def leaderboard(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with ``metric``, ``score``, ``task`` and ``timestamp`` ranked: scored first, by task, score, newest.

    With ``limit`` only the top rows are sorted out of each partition.
    """
    value = F.when(lower_column(F.col("metric")), -F.col("score")).otherwise(F.col("score"))
    ordered = runs.withColumns({"unscored": (F.col("metric") == "score").cast("int"), "sort_value": value}).orderBy("unscored", F.col("task").asc_nulls_last(), F.desc("sort_value"), F.desc("timestamp"), "run_id", "model")
    return ordered.limit(limit) if limit else ordered


def champions(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The best run of each key by its direction-normalised score, the newest of equal ones."""
    value = F.when(lower_column(F.col("metric")), -F.col("score")).otherwise(F.col("score"))
    return newest(runs.withColumn("sort_value", value), keys, [F.desc("sort_value"), F.desc("timestamp"), F.col("run_id"), F.col("model")])


def run_diff(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(model, metric, score_a, score_b, delta) of two runs side by side; what only one has stays."""
    each = runs.select("run_id", "model", F.explode("cv_scores").alias("metric", "value"))
    one = each.where(F.col("run_id") == a).groupBy("model", "metric").agg(F.max("value").alias("score_a"))
    two = each.where(F.col("run_id") == b).groupBy("model", "metric").agg(F.max("value").alias("score_b"))
    return one.join(two, ["model", "metric"], "full_outer").withColumn("delta", F.col("score_b") - F.col("score_a"))


def last_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("line")).limit(n)


class Registry:
    """Champions in a JSON file: key to model, run, score, metric, artifact and time."""

    def __init__(self, path: str):
        self.path = Path(path)

    def load(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def _save(self, data: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        staging = self.path.with_name("." + self.path.name)
        staging.write_text(json.dumps(data, sort_keys=True, indent=2))
        staging.replace(self.path)

    def reset(self) -> None:
        """No champions."""
        self._save({})

    def promote(self, key: str, entry: dict, force: bool = False) -> bool:
        """Take the entry if it is strictly better; one of another metric only by ``force``."""
        data = self.load()
        old = data.get(key)
        if old and not force:
            if old["metric_name"] != entry["metric_name"]:
                return False
            better = entry["score"] < old["score"] if lower_is_better(entry["metric_name"]) else entry["score"] > old["score"]
            if not better:
                return False
        data[key] = entry
        self._save(data)
        return True

    def update(self, runs: DataFrame, key: str = "task") -> list[str]:
        """Promote each key's champion; the keys that changed."""
        changed = []
        for r in champions(runs, [key]).collect():
            entry = {"model": r.model, "run_id": r.run_id, "score": r.score, "metric_name": r.metric, "artifact_path": r.artifact_path, "registered_at": str(r.timestamp)}
            if self.promote(r[key] or "default", entry):
                changed.append(r[key])
        return changed


def state_markdown(events: DataFrame, registry: dict, top: int = 10) -> str:
    """A short report: leaderboard, champions and the last errors."""
    runs = with_primary(dedupe_events(events))
    lines = ["# State", "", "## Leaderboard", "", "| model | task | metric | score | run |", "|-|-|-|-|-|"]
    lines += [f"| {r.model} | {r.task or ''} | {r.metric} | {r.score:.4f} | {r.run_id} |" for r in leaderboard(runs, top).collect()]
    lines += ["", "## Champions", ""]
    lines += [f"- {k}: {v['model']} ({v['metric_name']} {v['score']:.4f}, run {v['run_id']})" for k, v in sorted(registry.items())]
    failed = events.where("error is not null").orderBy(F.desc("timestamp")).limit(5).collect()
    lines += ["", "## Errors", ""] + [f"- {r.model or ''}: {r.error}" for r in failed]
    return "\n".join(lines) + "\n"


#: Fields of a run that may be published.
PUBLIC = ("run_id", "timestamp", "model", "task", "dataset", "n_rows", "metric", "score", "cv_scores", "cv_std", "lift", "calibration", "duration_seconds")


def docs_json(events: DataFrame, registry: dict, limit: int = 100) -> dict[str, str]:
    """Documents for a web page: ``summary`` and ``runs`` as JSON, the newest ``limit`` runs, public fields only."""
    runs = with_primary(dedupe_events(events))
    newest_first = runs.orderBy(F.desc("timestamp"), "run_id", "model").limit(limit).select(*[c for c in PUBLIC if c in runs.columns])
    by = runs.groupBy("task").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("model").alias("models")).orderBy("task")
    champions_ = {k: {f: v[f] for f in ("model", "metric_name", "score", "run_id")} for k, v in sorted(registry.items())}
    return {
        "summary": json.dumps({"tasks": [r.asDict() for r in by.collect()], "champions": champions_}, sort_keys=True),
        "runs": "[" + ", ".join(newest_first.toJSON().collect()) + "]",
    }
