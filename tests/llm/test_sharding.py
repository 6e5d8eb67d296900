import random
import zlib
from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from loomtab.llm import sharding as S


def best(sizes, shards):
    n = len(sizes)
    return min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, n))) for c in combinations_with_replacement(range(n + 1), shards - 1))


def test_capacity_is_smallest():
    r = random.Random(3)
    for _ in range(200):
        sizes = [r.choice([1, 2, 5, 30]) for _ in range(r.randint(1, 9))]
        shards = r.randint(1, 4)
        assert S.smallest_capacity(sizes, shards)[0] == best(sizes, shards)


def test_refinement_equals_the_flat_answer(monkeypatch):
    monkeypatch.setattr(S, "FIRST_DIGITS", 1)
    monkeypatch.setattr(S, "MORE_DIGITS", 1)
    r = random.Random(5)
    for trial in range(60):
        groups = {f"{r.getrandbits(128):032x}": r.choice([1, 3, 10, 400 if trial % 3 else 9]) for _ in range(r.randint(1, 400))}
        shards = r.choice([2, 3, 16])

        def count(prefixes, digits):
            found = {}
            for k, v in groups.items():
                if not prefixes or any(k.startswith(p) for p in prefixes):
                    s, n = found.get(k[:digits], (0, 0))
                    found[k[:digits]] = s + v, n + 1
            return sorted((S.Item(p, s, n) for p, (s, n) in found.items()), key=lambda i: i.prefix)

        bounds = S.minimax_boundaries(count, max(groups.values()), shards)
        loads = [0] * shards
        for k, v in groups.items():
            loads[sum(k >= b for b in bounds)] += v
        assert max(loads) == S.smallest_capacity([v for _, v in sorted(groups.items())], shards)[0]


def check(rows, shards):
    by, texts = {}, {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        texts.setdefault(r.text, set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(len(v) == 1 for v in texts.values()) and set(by) <= set(range(shards))


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "a"), (5, "é" * 5000)] + [(10 + i, "hot") for i in range(300)] + [(400 + i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bytes", F.lit(1))
    got = S.shard_minimax(df, 4).collect()
    assert len(got) == len(rows)
    check(got, 4)
    assert S.shard_minimax(df.limit(0), 4).count() == 0
    check(S.shard_minimax(df.limit(2), 4).collect(), 4)


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op2_minimax_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by, homes, loads = {}, {}, [0] * 16
    groups = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
        loads[r.shard] += r.size
        groups[raw] = groups.get(raw, 0) + r.size
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(len(v) == 1 for v in homes.values())
    import hashlib

    order = sorted(groups, key=lambda raw: hashlib.md5(hashlib.md5(raw).hexdigest().encode()).hexdigest())
    assert max(loads) == S.smallest_capacity([groups[x] for x in order], 16)[0]


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}" if i % 5 else None, i * 2) for i in range(60)], "_size int, text string, row int")
    df = df.selectExpr("*", "'k' as _key", "1 as size", "2 as key", "3 as bucket", "4 as number", "5 as n", "6 as before")
    got = S.shard_minimax(df, 4)
    assert got.columns == [*df.columns, "shard", "slot"]
    assert got.drop("shard", "slot").exceptAll(df).isEmpty() and got.count() == 60
    by = {}
    for r in got.collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
