import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtab.llm import vectors as V


def brute(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of every row by all pairs."""
    ok = [l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    unit = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if o else None for o, (_, v, _) in zip(ok, rows, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    out = []
    for i, (k, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((k, links[i], c, k == c))
    return sorted(out, key=str)


def clusters(seed, centres, each, dim, noise):
    r = np.random.default_rng(seed)
    base = r.normal(size=(centres, dim))
    return [(int(1000 * c + i), [float(np.float32(x)) for x in base[c] / np.linalg.norm(base[c]) + noise * r.normal(size=dim)], int(c % 3)) for c in range(centres) for i in range(each)]


ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [float("nan"), 1.0, 1.0], 1), (6, [float("inf"), 1.0, 1.0], 1),
    (7, [1.0, 2.0, 3.0], None), (8, [1.0, 2.0, 3.0], 1), (9, [2.0, 4.0, 6.0], 1), (9, [2.0, 4.0, 6.0], 1), (10, [1.0, 2.0, 3.0], 2), (11, [1.0, 2.0, 3.0, 0.0], 1),
    (None, [1.0, 2.0, 3.01], 1), (None, [-1.0, 5.0, 3.0], 1), (None, None, 1), (12, [1e-30, 2e-30, 3e-30], 1), (13, [5.0], 1), (14, [7.0], 1), (15, [-7.0], 1), (8, [-3.0, 1.0, 0.0], 1),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows(spark, kind):
    rows = [(i, v if v is None or kind == "double" else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in ODD]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"class": F.lit("x"), "n": F.lit(1), "usable": F.lit(3), "bucket": F.lit(None).cast("int")})
    assert sorted(map(tuple, V.near_duplicates(df).collect()), key=str) == brute(rows)


def test_doubles_of_any_size_and_labels_of_text(spark):
    rows = [(1, [1e300, 2e300], "a"), (2, [1e-300, 2e-300], "a"), (3, [1.0, 2.0], "b"), (4, [1.0, 2.0], "a")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")
    assert sorted(map(tuple, V.near_duplicates(df).collect()), key=str) == brute(rows)


def test_clusters_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", 64 * 8 * 16)
    rows = clusters(5, 6, 90, 16, 0.012)
    rows += [(90_000 + i, rows[0][1], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, V.near_duplicates(df).collect()), key=str)
    want = brute(rows)
    assert sum(x[1] for x in got) >= 0.999 * sum(x[1] for x in want)
    assert sum(x == y for x, y in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_empty(spark):
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("corners", [2, 3])
def test_recall(corners):
    rows = clusters(3, 300, 12, 64, 0.011)
    unit = V.units(pa.array([v for _, v, _ in rows]), 64)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))
    met = np.zeros(len(a), bool)
    for t in range(V.TABLES):
        codes = V.buckets(unit, t, corners)
        met |= (codes[a][:, :, None] == codes[b][:, None, :]).any((1, 2))
    assert len(a) > 5000 and met.mean() > 0.995


def test_hadamard_is_orthogonal():
    h = V.hadamard(np.eye(16))
    assert np.array_equal(h @ h.T, 16 * np.eye(16)) and set(np.unique(h)) == {-1.0, 1.0}


def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    found, want = V.op12_cross_polytope(spark, sf), con.sql(V.ORACLES["op12_cross_polytope"])
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
