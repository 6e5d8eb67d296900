import re
from fractions import Fraction
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from loomtab.llm import filter_audit as A

WORDS = " ".join(f"word{i}" for i in range(60))
SMALL = [
    (1, WORDS, "x"), (2, WORDS, "x"), (2, WORDS, "x"), (3, WORDS + " #", None), (4, None, "y"), (5, "", ""), (6, "A B C", "x"), (7, WORDS.upper(), "y"),
    (8, "the same " * 40, "x"), (9, "THE SAME | " * 40, "x"), (None, WORDS, "x"), (None, "", "y"), (10, "  \t\x0b\n ", "y"), (11, WORDS, "y"), (12, "ÄÖ " * 55, "y"),
    (13, "w\x1c\x85x " + WORDS, "z"), (0, "A B C", "z"), (14, "ab " * 200_000, "x"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (6, 1, 1), (9, None, 1), (None, 1, 1), (77, 1, 1), (8, 1, None), (14, 0, 0)]


def brute(rows, labels):
    def fails(i, text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": earlier}

    found = []
    for i, t, s in rows:
        good, toxic = (any(j == i and r[k] == 1 for j, *r in labels if i is not None) for k in (0, 1))
        found.append((s or "", fails(i, t), good, toxic))
    out, total = {}, {}
    for part in {f[0] for f in found}:
        own = [f for f in found if f[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for k, c in enumerate(order):
                gone = [f for f in left if f[1][c]]
                left = [f for f in left if not f[1][c]]
                total[part, c] = total.get((part, c), 0) + len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f[1][c] for f in own) - len(gone), sum(f[1][c] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_against_all_orders_by_hand(spark):
    docs = spark.createDataFrame(SMALL, "doc_id long, text string, source string").withColumns({"mask": F.lit("x"), "part": F.lit(3), "n": F.lit(None).cast("int"), "digest": F.lit(1)})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit(9))
    assert sorted(map(tuple, A.filter_audit(docs, labels).collect())) == brute(SMALL, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    assert A.filter_audit(one, labels).agg(F.sum("removed")).first()[0] == 120


def test_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = A.op13_shapley_audit(spark, sf)
    want = con.sql(A.ORACLES["op13_shapley_audit"])
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_polynomial():
    counts = [5, 3, 0, 2, 7, 0, 1, 4]
    p = A.RemovalPolynomial(counts)
    assert p.total == 22 and p.corners() == [sum(n for m, n in enumerate(counts) if m & s) for s in range(8)]
    for i in range(3):
        assert p.shapley(i) == sum(Fraction(n, m.bit_count()) for m, n in enumerate(counts) if m >> i & 1)
    assert sum(p.shapley(i) for i in range(3)) == p.corner(7)
