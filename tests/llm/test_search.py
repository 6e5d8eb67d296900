import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtab.llm import search as S


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(S.TERM, text or "")]


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, found = Counter(terms(text)), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, rank + 1, i, score) for rank, (_, _, i, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit("x"), "term": F.lit(1), "n": F.lit(None).cast("int"), "ids": F.lit(2)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit("x"), "rank": F.lit(3), "score": F.lit(1), "doc_id": F.lit(1)})
    return d, q


ODD_DOCS = [
    (1, None), (2, ""), (3, " \n ..."), (4, "Grüße GRÜSSE größe"), (5, "a a a b"), (6, "a b"), (6, "a b"), (7, "A,B;a_b"), (None, "a b"), (8, "x\x7fy x-1 9z"),
    (10, "long " * 50_000 + "needle"), (9, "日本語 日本語 text"), (11, "tie one"), (12, "tie one"), (0, "tie one"), (-5, "tie one"),
]
ODD_ITEMS = [(1, "a b b"), (2, None), (3, ""), (4, "needle long"), (5, "GRÜSSE 日本語"), (6, "absent words"), (7, "tie"), (7, "one"), (1, "a b b"), (None, "x y 9Z")]


def test_odd_rows(spark):
    d, q = frames(spark, ODD_DOCS, ODD_ITEMS)
    got = sorted(map(tuple, S.search_index(S.build_index(d.repartition(3)), q).collect()), key=str)
    assert got == brute(ODD_DOCS, ODD_ITEMS)


def test_empty(spark):
    d, q = frames(spark, [], [(1, "a")])
    assert S.search_index(S.build_index(d), q).count() == 0
    d, q = frames(spark, [(1, "a")], [])
    assert S.search_index(S.build_index(d), q).count() == 0


def test_many_shards_and_blocks(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    word = lambda: vocabulary[min(int(r.expovariate(0.02)), 299)]
    docs = [(r.randrange(500), " ".join(word() for _ in range(r.randrange(1, 60)))) for _ in range(400)]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 25)))) for i in range(30)]
    monkeypatch.setattr(S, "QUERY_TERMS", 90)
    d, q = frames(spark, docs, items)
    index = S.build_index(d.repartition(7))
    assert sorted(map(tuple, S.search_index(index, q).collect()), key=str) == brute(docs, items)
    assert sorted(map(tuple, S.search_index(index, q, 3).collect()), key=str) == brute(docs, items, 3)


def test_shards_of_portions(monkeypatch):
    monkeypatch.setattr(S, "PORTION", 64)
    r = random.Random(2)
    texts = [" ".join(r.choice(["aa", "Bb", "c", "ddd" * 40, "ü"]) for _ in range(r.randrange(0, 80))) for _ in range(9)]
    builder = S.ShardBuilder(5)
    builder.add(list(range(9, 0, -1)), pa.array(texts))
    rows = pa.Table.from_batches(list(builder.rows()))
    head, *rest = rows.to_pylist()
    counts = {9 - i: Counter(terms(t)) for i, t in enumerate(texts) if terms(t)}
    assert head["ids"] == sorted(counts) and S.decode_ints(np.frombuffer(head["counts"], np.uint8)).tolist() == [sum(counts[i].values()) for i in head["ids"]]
    got = {}
    for x in rest:
        at = np.cumsum(S.decode_ints(np.frombuffer(x["docs"], np.uint8)))
        got[x["term"]] = {head["ids"][k]: c for k, c in zip(at, S.decode_ints(np.frombuffer(x["counts"], np.uint8)).tolist(), strict=True)}
        assert x["n"] == len(got[x["term"]]) and x["total"] == sum(got[x["term"]].values())
    assert got == {t: {i: c[t] for i, c in counts.items() if c[t]} for t in {t for c in counts.values() for t in c}}


@pytest.mark.parametrize("values", [[], [0], [127, 128, 16383, 16384, 2**62, 0, 1]])
def test_integers(values):
    data, sizes = S.encode_ints(np.array(values, np.int64))
    assert S.decode_ints(data).tolist() == values and sizes.sum() == len(data)


def test_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, want = S.op11_ranked_search(spark, sf), con.sql(S.ORACLES["op11_ranked_search"])
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
