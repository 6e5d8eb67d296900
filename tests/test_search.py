import math
import random
import statistics

import numpy as np
import pytest

from loomtab.operators import search as S

SPACE = {"x": ("float", -5.0, 5.0), "rate": ("log", 1e-4, 1.0), "depth": ("int", 1, 12), "kind": ["a", "b", "c"]}


def known(s):
    """Best at x = 2, rate = 0.01, depth = 7, kind b."""
    return -((s["x"] - 2) ** 2) - 2 * (math.log10(s["rate"]) + 2) ** 2 - 0.3 * (s["depth"] - 7) ** 2 - 3 * (s["kind"] != "b")


def test_beats_random_draws():
    best = {k: [S.search(known, SPACE, "r2", 50, seed, sampler=k)[0].score for seed in range(12)] for k in ("tpe", "random")}
    assert statistics.mean(best["tpe"]) > statistics.mean(best["random"]) + 0.5
    assert sum(a > b for a, b in zip(best["tpe"], best["random"], strict=True)) >= 8


def test_settings_stay_in_their_space_and_errors_are_kept():
    def objective(s):
        assert -5 <= s["x"] <= 5 and 1e-4 <= s["rate"] <= 1 and s["depth"] in range(1, 13) and s["kind"] in "abc"
        if s["kind"] == "a":
            raise ValueError("no a")
        return known(s)

    best, trials = S.search(objective, SPACE, "r2", 40, 3)
    assert best.settings["kind"] != "a" and all(t.error == "no a" for t in trials if t.settings["kind"] == "a")
    assert S.search(lambda s: -known(s), SPACE, "rmse", 40, 3)[0].score < 6
    with pytest.raises(S.SearchError):
        S.search(known, SPACE, "r2", 1, sampler="other")


def test_warm_trials_count():
    warm = [S.Trial({"x": 2 + i / 50, "rate": 0.01, "depth": 7, "kind": "b"}, -i / 1000) for i in range(12)] + [S.Trial({"x": -4.0, "rate": 1.0, "depth": 2, "kind": "a"}, -90.0)] * 20
    warm += [S.Trial({"x": "odd", "kind": "z"}, -95.0), S.Trial({}, None, "failed")]
    with_warm = [S.search(known, SPACE, "r2", 5, seed, warm)[1][len(warm) :] for seed in range(8)]
    without = [S.search(known, SPACE, "r2", 5, seed)[1] for seed in range(8)]
    mean = lambda runs: statistics.mean(t.score for run in runs for t in run)
    assert mean(with_warm) > mean(without) + 5


def test_halving():
    seen = []

    def objective(s, share):
        seen.append(share)
        return known(s) + random.Random(str(s)).gauss(0, 0.2 * (1 - share))

    best, rungs = S.successive_halving(objective, SPACE, "r2", trials=18)
    assert [len(r) for r in rungs] == [18, 6, 2] and sorted(set(seen)) == pytest.approx([1 / 9, 1 / 3, 1])
    assert best.score == max(t.score for t in rungs[-1]) and best.score >= sorted(known(t.settings) for t in rungs[0])[-4]
    with pytest.raises(S.SearchError):
        S.successive_halving(lambda s, share: 1 / 0, SPACE, "r2")


def test_samples_are_nested(spark):
    df = spark.range(2000)
    third, ninth = S.hash_sample(df, 1 / 3), S.hash_sample(df, 1 / 9)
    assert ninth.subtract(third).count() == 0 and abs(third.count() - 667) < 100 and S.hash_sample(df, 1.0).count() == 2000


def test_an_idle_setting_of_a_learning_search_decides_nothing():
    """All best trials had one value of ``z`` by chance, which took over half of the importance for most seeds."""
    space = {"x": ("float", 0, 6), "z": [1, 2]}
    for seed in range(42, 52):
        trials = S.search(lambda s: -((s["x"] - 3) ** 2), space, "roc_auc", 40, seed=seed)[1]
        for got in (S.importances(trials), S.importances(trials, "roc_auc", space, even=True)):
            assert got["x"] > 0.75 and sum(got.values()) == pytest.approx(1)


def test_importance_agrees_with_a_direct_integral():
    r = random.Random(1)
    trials = [S.Trial({"x": (x := r.uniform(-5, 5)), "idle": r.random(), "kind": (k := r.choice("ab"))}, -((x - 2) ** 2) - (k == "a")) for _ in range(300)]
    got = S.importances(trials, "r2", {"x": ("float", -5, 5), "idle": ("float", 0, 1), "kind": ["a", "b"]})
    assert got["x"] > 0.6 and got["x"] > 5 * got["idle"] and sum(got.values()) == pytest.approx(1)
    ranked = sorted(trials, key=lambda t: -t.score)

    def density(part, name, low, high):
        u = np.array([(t.settings[name] - low) / (high - low) for t in part])
        h = max(0.6 * u.std() * len(u) ** -0.2, 0.03)
        phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        return lambda x: (1 + sum(math.exp(-0.5 * ((x - m) / h) ** 2) / (h * math.sqrt(2 * math.pi) * (phi((1 - m) / h) - phi(-m / h))) for m in u)) / (len(u) + 1)

    want = {}
    for name, low, high in (("x", -5, 5), ("idle", 0, 1)):
        p, q = density(ranked[:75], name, low, high), density(ranked, name, low, high)
        xs = np.linspace(0, 1, 801)
        want[name] = float(np.trapezoid([(p(x) / q(x) - 1) ** 2 * q(x) for x in xs], xs))
    assert got["x"] / got["idle"] == pytest.approx(want["x"] / want["idle"], rel=1e-3)
