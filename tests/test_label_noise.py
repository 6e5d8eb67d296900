import numpy as np
import pytest

from loomtab.operators import audit


def brute(y, p):
    k = p.shape[1]
    bars = [p[y == c, c].mean() if (y == c).any() else 2.0 for c in range(k)]
    counts = np.zeros((k, k), int)
    for label, row in zip(y, p, strict=True):
        sure = [c for c in range(k) if row[c] >= bars[c]]
        if sure:
            counts[label, max(sure, key=lambda c: row[c])] += 1
    joint = np.array([[int(np.floor(c * (y == i).sum() / max(row.sum(), 1) + 0.5)) for c in row] if row.sum() else [(y == i).sum() * (i == j) for j in range(k)] for i, row in enumerate(counts)])
    issue = np.zeros(len(y), bool)
    for i in range(k):
        for j in range(k):
            own = np.flatnonzero(y == i)
            if i != j and joint[i, j] and len(own):
                lead = p[own, j] - p[own, i]
                issue[own[lead >= np.sort(lead)[::-1][min(joint[i, j], len(own)) - 1]]] = True
    return counts, joint, issue & (p.argmax(1) != y)


@pytest.mark.parametrize(("seed", "k", "n"), [(1, 2, 300), (2, 4, 500), (3, 3, 12)])
def test_joint_and_issues_against_brute_force(spark, seed, k, n):
    r = np.random.default_rng(seed)
    truth = r.integers(0, k, n)
    y = np.where(r.random(n) < 0.15, r.integers(0, k, n), truth)
    z = r.normal(size=(n, k)) + 2.0 * np.eye(k)[truth]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    df = spark.createDataFrame([(str(i), int(a), [float(x) for x in row]) for i, (a, row) in enumerate(zip(y, p, strict=True))], "row_id string, y int, probability array<double>")
    counts, joint, issue = brute(y, p)
    got = audit.confident_counts(df, k)
    assert got == counts.tolist()
    own = audit.estimated_joint(got, [int((y == c).sum()) for c in range(k)])
    assert own == joint.tolist()
    rows = {int(r.row_id): r for r in audit.noisy_rows(df, own).collect()}
    assert [rows[i].is_issue for i in range(n)] == issue.tolist()
    assert [rows[i].quality_score for i in range(n)] == pytest.approx(p[np.arange(n), y].tolist())


def test_flipped_labels_are_found(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 2))
    truth = (x.sum(1) > 0).astype(int)
    flipped = (np.abs(x.sum(1)) > 1.2) & (r.random(400) < 0.1)
    rows = [(f"r{i}", float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, np.where(flipped, 1 - truth, truth), strict=True))]
    report = audit.label_noise(spark.createDataFrame(rows, "row_id string, a double, b double, y int"), ["a", "b"], "y")
    found = {int(r.row_id[1:]) for r in report.scores.where("is_issue").collect()}
    hit = set(np.flatnonzero(flipped).tolist())
    assert len(found & hit) >= 0.8 * len(hit) and len(found) <= 2.5 * len(hit) and report.n_issues == len(found)
    assert not audit.label_noise(spark.createDataFrame(rows[:3], "row_id string, a double, b double, y int").selectExpr("row_id", "a", "b", "1 as y"), ["a"], "y").enabled
