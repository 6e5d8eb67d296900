import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import embedding as E


def shops(spark, n=600):
    """Shops of three kinds, which show in what is sold and in the target."""
    r = np.random.default_rng(2)
    rows = []
    for _ in range(n):
        s = int(r.integers(0, 30))
        kind = s % 3 if r.random() < 0.85 else int(r.integers(0, 3))
        rows.append((f"s{s}" if s else None, f"p{kind}{r.integers(0, 3)}", f"t{kind}"))
    return spark.createDataFrame(rows, "shop string, product string, y string")


def test_vectors_span_the_exact_space(spark):
    df = shops(spark)
    edges = E.normalised(E.co_occurrence(df, ["shop", "product", "y"]))
    rows = edges.collect()
    names = sorted({r.u for r in rows})
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names.index(r.u), names.index(r.v)] = r.w
    assert np.allclose(m, m.T)
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:3]
    found, got = E.top_vectors(edges, 3, rounds=10)
    assert got == pytest.approx(values[order].tolist(), abs=1e-4)
    held = {r.node: r.vector for r in found.collect()}
    q = np.array([held[n] for n in names])
    # cosines of the angles between both spaces
    assert np.linalg.svd(q.T @ vectors[:, order])[1] == pytest.approx([1, 1, 1], abs=1e-4)


def test_like_shops_are_near(spark):
    tables = E.fit_embeddings(shops(spark), ["shop"], 4, ["product", "y"])
    rows = {r.value: np.array(r[1:]) for r in tables["shop"].collect()}
    assert len(rows) == 30 and None in rows and all(len(v) == 4 for v in rows.values())
    unit = {k: v[1:] / np.linalg.norm(v[1:]) for k, v in rows.items() if k}
    near = [unit[a] @ unit[b] for a in unit for b in unit if a < b and int(a[1:]) % 3 == int(b[1:]) % 3]
    far = [unit[a] @ unit[b] for a in unit for b in unit if a < b and int(a[1:]) % 3 != int(b[1:]) % 3]
    assert np.mean(near) > np.mean(far) + 0.5


def test_low_rank_and_lone_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x")], "u string, v string")
    one = E.fit_embeddings(df, ["u"], 3, ["v"])["u"].collect()
    assert {r.value for r in one} == {"a", "b", None} and all(r.emb_2 == 0 for r in one)
    assert all(r.emb_0 == 0 for r in E.fit_embeddings(df, ["u"], 2)["u"].collect())
    assert E.fit_embeddings(df.limit(0), ["u"], 2, ["v"])["u"].count() == 0


def test_moments_equal_the_mean_of_sampled_noise():
    r = np.random.default_rng(7)
    n, sizes, noise = 60, (3, 2, 4), 0.3
    codes = np.stack([r.integers(0, s, n) for s in sizes], 1)
    codes[:, 2] = (codes[:, 0] + (r.random(n) < 0.3)) % 4
    hot = lambda c: np.concatenate([np.eye(s)[c[:, i]] for i, s in enumerate(sizes)], 1)
    x, block = hot(codes), np.repeat(np.arange(3), sizes)
    mixed, both = E.swapped_moments(x.T @ x / n, x.mean(0), block, noise)
    sums = [np.zeros_like(mixed), np.zeros_like(mixed)]
    rounds = 6000
    for _ in range(rounds):
        drawn = np.stack([r.permutation(codes[:, i])[r.integers(0, n, n)] for i in range(3)], 1)
        noisy = hot(np.where(r.random(codes.shape) < noise, drawn, codes))
        sums[0] += x.T @ noisy / n
        sums[1] += noisy.T @ noisy / n
    assert np.abs(sums[0] / rounds - mixed).max() < 3e-3 and np.abs(sums[1] / rounds - both).max() < 3e-3


def test_denoiser(spark):
    df = shops(spark)
    found = E.fit_denoiser(df, ["shop", "product", "y"], latent=3, noise=0.2)
    assert [len(v) for v in found.values] == [29, 9, 3]
    rows = df.withColumn("z", found.encode()).collect()
    z = np.array([r.z for r in rows])
    assert z.shape == (600, 3) and np.abs(z.mean(0)).max() < 1e-9
    # the target's three classes stand apart in the bottleneck
    centre = {k: z[[r.y == k for r in rows]].mean(0) for k in ("t0", "t1", "t2")}
    hit = [min(centre, key=lambda k, v=v: np.linalg.norm(v - centre[k])) == r.y for v, r in zip(z, rows, strict=True)]
    assert np.mean(hit) > 0.95
    assert all(abs(x) < 10 for x in df.limit(1).withColumn("shop", F.lit("unseen")).select(found.encode()).first()[0])
    # against the problem written out with numpy
    second, mean, block = E.one_hot_moments(df, found.columns, found.values)
    c = second - np.outer(mean, mean)
    mixed, both = E.swapped_moments(c, 0 * mean, block, 0.2)
    w = mixed @ np.linalg.inv(both + 1e-6 * np.eye(len(mean)))
    u = np.linalg.eigh(w @ both @ w.T)[1][:, ::-1][:, :3]
    e = np.array(found.encoder)
    assert np.allclose(np.abs(u.T @ w), np.abs(e), atol=1e-6)
