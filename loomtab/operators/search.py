"""Search over model settings: Parzen densities of past trials, halving on growing samples, warm starts, importances."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import lower_is_better

#: Search spaces: name -> (kind, low, high) with kind int, float or log, or a list of choices.
SPACES: dict[str, dict] = {
    "linear": {"c": ("log", 1e-3, 1e2)},
    "gbt": {"trees": ("int", 20, 120), "depth": ("int", 2, 8), "step": ("log", 0.01, 0.3)},
    "forest": {"trees": ("int", 20, 200), "depth": ("int", 3, 14)},
}


@dataclass(frozen=True)
class Trial:
    settings: dict
    score: float | None
    error: str | None = None


def draw(space: dict, r: random.Random) -> dict:
    out = {}
    for name, what in space.items():
        if isinstance(what, list):
            out[name] = r.choice(what)
        elif what[0] == "int":
            out[name] = r.randint(what[1], what[2])
        elif what[0] == "log":
            out[name] = math.exp(r.uniform(math.log(what[1]), math.log(what[2])))
        else:
            out[name] = r.uniform(what[1], what[2])
    return out


class SearchError(RuntimeError):
    """Too few trials survived."""


#: Trials before densities say anything; share of trials that count as good; draws among which the likeliest good one is taken.
STARTUP, GOOD, DRAWS = 10, 0.1, 24


def _unit(value: float, what: tuple) -> float:
    """A number of a range as a place from 0 to 1, on a log scale if the range is."""
    low, high = what[1], what[2]
    if what[0] == "log":
        value, low, high = math.log(value), math.log(low), math.log(high)
    return (value - low) / (high - low) if high > low else 0.5


def _of_unit(x: float, what: tuple):
    low, high = what[1], what[2]
    if what[0] == "log":
        return min(max(math.exp(math.log(low) + x * (math.log(high) - math.log(low))), low), high)
    value = low + x * (high - low)
    return min(max(round(value), low), high) if what[0] == "int" else value


@dataclass(frozen=True)
class Parzen:
    """A mixture of normals on 0 to 1, each cut off at the ends, and one even part as prior."""

    at: tuple[float, ...]
    width: float

    @classmethod
    def of(cls, places: list[float]) -> Parzen:
        n = max(len(places), 1)
        spread = float(np.std(places)) if len(places) > 1 else 0.3
        return cls(tuple(places), max(0.6 * spread * n**-0.2, 0.03))

    def density(self, x: np.ndarray) -> np.ndarray:
        total = np.ones_like(x)
        for m in self.at:
            inside = 0.5 * (math.erf((1 - m) / self.width / math.sqrt(2)) - math.erf(-m / self.width / math.sqrt(2)))
            total = total + np.exp(-0.5 * ((x - m) / self.width) ** 2) / (self.width * math.sqrt(2 * math.pi) * inside)
        return total / (len(self.at) + 1)

    def draw(self, r: random.Random) -> float:
        i = r.randrange(len(self.at) + 1)
        if i == len(self.at):
            return r.random()
        while True:
            x = r.gauss(self.at[i], self.width)
            if 0 <= x <= 1:
                return x


def _shares(values: list, choices: list) -> dict[str, float]:
    """How often each choice was taken, with one more trial of each."""
    return {str(c): (sum(str(v) == str(c) for v in values) + 1) / (len(values) + len(choices)) for c in choices}


def _best_first(trials: list[Trial], metric: str) -> list[Trial]:
    alive = [t for t in trials if t.score is not None and math.isfinite(t.score)]
    return sorted(alive, key=lambda t: t.score, reverse=not lower_is_better(metric))


def suggest(space: dict, past: list[Trial], metric: str, r: random.Random) -> dict:
    """Settings by the ratio of two Parzen densities, of good past trials and of the others, for each setting by itself.

    Past trials may lack a setting or have one that is not in the space; such values say nothing about it.
    """
    ranked = _best_first(past, metric)
    if len(ranked) < STARTUP:
        return draw(space, r)
    n = max(1, math.ceil(GOOD * len(ranked)))
    out = {}
    for name, what in space.items():
        good, rest = ([t.settings[name] for t in part if _known(t.settings.get(name), what)] for part in (ranked[:n], ranked[n:]))
        if isinstance(what, list):
            likely, other = _shares(good, what), _shares(rest, what)
            tries = r.choices(what, [likely[str(c)] for c in what], k=DRAWS)
            out[name] = max(tries, key=lambda c: likely[str(c)] / other[str(c)])
        else:
            likely, other = (Parzen.of([_unit(float(v), what) for v in part]) for part in (good, rest))
            tries = np.array([likely.draw(r) for _ in range(DRAWS)])
            out[name] = _of_unit(float(tries[np.argmax(likely.density(tries) / other.density(tries))]), what)
    return out


def _known(value, what) -> bool:
    if isinstance(what, list):
        return any(str(value) == str(c) for c in what)
    try:
        return what[1] <= float(value) <= what[2]
    except (TypeError, ValueError):
        return False


def _tried(objective: Callable[[], float], settings: dict) -> Trial:
    try:
        score = float(objective())
        return Trial(settings, None if math.isnan(score) else score)
    except Exception as e:  # a setting that the model refuses
        return Trial(settings, None, str(e))


def _winner(trials: list[Trial], metric: str, survivors: int) -> Trial:
    alive = [t for t in trials if t.score is not None]
    if len(alive) < survivors:
        raise SearchError(f"{len(alive)} of {len(trials)} trials survived")
    return (min if lower_is_better(metric) else max)(alive, key=lambda t: t.score)


def search(objective: Callable[[dict], float], space: dict, metric: str, trials: int = 20, seed: int = 42, warm: list[Trial] | None = None, survivors: int = 1, sampler: str = "tpe") -> tuple[Trial, list[Trial]]:
    """The best trial and all trials; past trials in ``warm`` count and guide.  A failing trial is kept with its error.

    ``sampler``: ``tpe`` learns from the trials so far, ``random`` does not.
    """
    if sampler not in ("tpe", "random"):
        raise SearchError(f"no sampler {sampler}")
    r, done = random.Random(seed), list(warm or [])
    for _ in range(trials):
        settings = suggest(space, done, metric, r) if sampler == "tpe" else draw(space, r)
        done.append(_tried(lambda s=settings: objective(s), settings))
    return _winner(done, metric, survivors), done


def hash_sample(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """The rows whose hash falls into the first ``share``; a smaller share's rows are among those of a larger one."""
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))


def successive_halving(objective: Callable[[dict, float], float], space: dict, metric: str, trials: int = 9, keep: int = 3, rungs: int = 3, seed: int = 42, warm: list[Trial] | None = None) -> tuple[Trial, list[list[Trial]]]:
    """The best trial over all rows, and the trials of each rung.

    ``objective`` gets settings and a share of the rows.  The first rung tries ``trials`` settings on the smallest share,
    1 / keep ** (rungs - 1); each next one the best 1 / keep of the last on ``keep`` times as many rows; the last is on all rows.
    """
    r, found = random.Random(seed), []
    settings = [suggest(space, list(warm or []), metric, r) for _ in range(trials)]
    for k in range(rungs):
        share = float(keep) ** (k - rungs + 1)
        found.append([_tried(lambda s=s, share=share: objective(s, share), s) for s in settings])
        settings = [t.settings for t in _best_first(found[-1], metric)[: max(1, -(-len(settings) // keep))]]
        if not settings:
            raise SearchError(f"no trial survived on a share of {share:.3g}")
    return _winner(found[-1], metric, 1), found


def importances(trials: list[Trial], metric: str = "roc_auc", space: dict | None = None, share: float = 0.25, points: int = 1001, even: bool | None = None) -> dict[str, float]:
    """How much each setting decides whether a trial is among the best ``share``; sums to 1 if any does.

    It is the Pearson divergence between the setting's Parzen densities over the best trials and over all of them, or, if
    ``even``, an even one.  A search that learns draws most trials near the best, so that these differ little from
    all in what decides, and by chance in what does not: its trials need ``even``.  Without ``space``, a number's range is
    that of the trials, numbers of few values (each met four times on average) are choices, and ``even`` is taken unless it is False.
    """
    even = space is None if even is None else even
    ranked = _best_first(trials, metric)
    if len(ranked) < 2:
        return {}
    n = max(1, math.ceil(share * len(ranked)))
    out = {}
    for name in ranked[0].settings:
        values = [t.settings.get(name) for t in ranked]
        what = (space or {}).get(name)
        if what is None:
            numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) and 4 * len(set(values)) > len(values)
            what = ("float", min(values), max(values)) if numbers else sorted({str(v) for v in values})
        if isinstance(what, list):
            best, whole = _shares(values[:n], what), _shares([] if even else values, what)
            out[name] = sum((best[str(c)] / whole[str(c)] - 1) ** 2 * whole[str(c)] for c in what)
        else:
            x = (np.arange(points) + 0.5) / points
            best, whole = (Parzen.of([_unit(float(v), what) for v in part]).density(x) for part in (values[:n], [] if even else values))
            out[name] = float(np.mean((best / whole - 1) ** 2 * whole))
    total = sum(out.values())
    return {k: v / total if total else 0.0 for k, v in out.items()}


def warm_start(events: DataFrame, model: str, metric: str) -> tuple[list[Trial], DataFrame]:
    """Past trials of ``model`` with ``metric``, and a row of counts: injected, and skipped by reason."""
    done = events.where(F.col("event") == "model_completed")
    score = F.try_element_at("cv_scores", F.lit(metric))
    reason = (
        F.when(F.col("model").isNull(), "no_model")
        .when(F.col("model") != model, "other_model")
        .when(F.col("params").isNull() | (F.size("params") == 0), "no_params")
        .when(F.col("cv_scores").isNull() | (F.size("cv_scores") == 0), "no_scores")
        .when(score.isNull() | F.isnan(score), "other_metric")
        .otherwise("injected")
    )
    marked = done.withColumn("reason", reason)
    kinds = ["injected", "no_model", "other_model", "no_params", "no_scores", "other_metric"]
    counts = marked.agg(*[F.count_if(F.col("reason") == k).alias(k) for k in kinds])
    trials = [Trial(dict(r.params), r.s) for r in marked.where("reason = 'injected'").select("params", score.alias("s")).collect()]
    return trials, counts
