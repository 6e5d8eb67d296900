import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomtab.llm import jaccard as J
from loomtab.llm.components import connected_components


def sets(text, size=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=4, percent=85):
    s = [sets(t, size) for _, t in rows]
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(s[a] & s[b])
            if s[a] and s[b] and 100 * k >= percent * (len(s[a]) + len(s[b]) - k):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                comp[y] = x
    return sorted((i, len(x), find(i)) for (i, _), x in zip(rows, s, strict=True))


def edited(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def make(seed):
    r = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "two words", "a b c", "a b c", "a b c d", "A b\tc d"]
    passage = [f"common{i}" for i in range(60)]
    for f in range(8):
        base = [f"w{f}x{i}" for i in range(r.choice([20, 60, 150, 400]))] + passage * (f % 2)
        texts += [edited(r, base, r.randint(0, len(base) // 20)) for _ in range(r.choice([2, 5, 12]))]
    chain = [f"c{i}" for i in range(120)]
    for _ in range(15):
        chain = edited(r, chain, 2).split()
        texts.append(" ".join(chain))
    r.shuffle(texts)
    return list(enumerate(texts, 3))


def test_against_brute_force(spark, monkeypatch):
    for seed, small in ((1, False), (2, True)):
        if small:  # blocks and sub-tiles
            monkeypatch.setattr(J, "TILE", 5)
            monkeypatch.setattr(J, "FIRST_TILE", 4)
        rows = make(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(map(tuple, J.jaccard_components(df).collect()))
        assert got == brute(rows)


def test_other_size_and_threshold(spark):
    rows = make(3)
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()))
    assert got == brute(rows, 5, 80)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, None), (2, 3, 1)], key=str)
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmap_bounds_the_overlap():
    r = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 300, r.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        for bits in (64, 256, 1024):
            differ = int(np.bitwise_count(J.bitmap(a, bits) ^ J.bitmap(b, bits)).sum())
            assert (len(a) + len(b) - differ) // 2 >= len(np.intersect1d(a, b))
            assert (J._fold(J.bitmap(a, 2 * bits)[None])[0] == J.bitmap(a, bits)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(51), 0), 100: 0, 200: 200, 201: 200}


def test_against_sql(spark, sf):
    got = sorted(map(tuple, J.op5_jaccard_join(spark, sf).select("component_id", "doc_id", "n_shingles").collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(J.ORACLES["op5_jaccard_join"])
    assert got == sorted(want.select("component_id, doc_id, n_shingles").fetchall())


def test_regular_words_that_differ(spark):
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, " ".join([a, b] * 40)), (4, " ".join([b, a] * 39 + [b])), (5, f"{a} {a} {b} {b} {a}")]
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_size_bands_never_part_a_pair(spark):
    for percent in (80, 85, 50):
        pairs = [(a, b) for a in range(1, 400) for b in (a, -(-percent * a // 100)) if b >= 1 and 100 * min(a, b) >= percent * max(a, b)]
        df = spark.createDataFrame(pairs, "a long, b long")
        assert df.where(F.abs(J.size_band(F.col("a"), percent) - J.size_band(F.col("b"), percent)) > 1).count() == 0


def test_hot_list_with_few_others(spark, monkeypatch):
    """A list far over a tile: its main component meets the other members, not itself."""
    monkeypatch.setattr(J, "TILE", 3)
    rows = [("s", 1, i, 100 + i, 7 if i < 20 else i, (50 << 32) | 1) for i in range(24)]
    listed = spark.createDataFrame([(1, i, 100 + i, comp, place, 24, 9, 9) for _, _, i, _, comp, place in rows], "shingle long, id long, p1 long, comp long, place long, members long, size_band int, top int")
    tiles = {}
    for r in J._tiled(listed, 85).collect():
        tiles.setdefault((r.shingle, r.band, r.lo, r.hi), []).append((r.id, r.block))
    met = {frozenset((a, b)) for (_, _, lo, hi), own in tiles.items() for a, x in own for b, y in own if a != b and (lo == hi or x != y)}
    others = range(20, 24)
    assert {frozenset((a, b)) for a in others for b in range(24) if a != b} <= met
    assert sum(map(len, tiles.values())) < 24 * 5


def test_one_id_with_short_and_long_texts(spark):
    base = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(base[:30])), (1, " ".join(base)), (2, " ".join(base[:29])), (3, " ".join([*base, "end"])), (4, "far from all of them")]
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_hubs(spark, monkeypatch):
    from loomtab.llm import components as C

    monkeypatch.setattr(C, "HUB", 4)
    monkeypatch.setattr(C, "FEW", 0)
    edges = [(0, i) for i in range(1, 30)] + [(29, 40), (40, 41), (60, 61), (61, 62)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys([*range(30), 40, 41], 0), 60: 60, 61: 60, 62: 60}
