import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.llm import repeats as R


def brute(rows, length):
    seen = {}
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for (doc, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    assert all(r.text is not None for r in df.collect())
    return sorted(map(tuple, df.drop("text").collect()), key=str)


def make(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)]
    texts = [None, "", "short", "x" * 700, "ab" * 300, "x" * 59, "x" * 60, "x" * 61]
    base = prose(120)
    for _ in range(12):
        w = base.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [base, base]
    for _ in range(15):
        texts.append(prose(r.randint(0, 30)) + r.choice(shared)[r.randint(0, 20) :] + prose(20) + (r.choice(shared) if r.random() < 0.5 else ""))
    return list(enumerate(texts, 1))


def test_index_against_brute_force():
    r = random.Random(2)
    for _ in range(150):
        text = bytes(r.choice(b"ab\x00\xff") for _ in range(r.randint(1, 40)))
        if r.random() < 0.5:
            text = text * r.randint(1, 4) + text[: r.randint(0, 10)]
        index = R.run_length_index(np.frombuffer(text, np.uint8))
        assert index.lengths.sum() == len(text)
        want = [max([n for j in range(len(text)) if j != i for n in [next((k for k in range(len(text) - max(i, j)) if text[i + k] != text[j + k]), len(text) - max(i, j))]], default=0) for i in range(len(text))]
        assert index.matching_statistics().tolist() == want
    assert len(R.run_length_index(np.frombuffer(b"abcde" * 400, np.uint8)).symbols) < 12  # repeats are runs


@pytest.mark.parametrize(("seed", "length", "limit"), [(1, 60, None), (2, 60, 2), (5, 33, 1), (3, 100, None), (4, 20, None), (6, 100, 1)])
def test_against_brute_force(spark, monkeypatch, seed, length, limit):
    if limit:
        monkeypatch.setattr(R, "GROUP_LIMIT", limit)
    rows = make(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert plain(R.repeat_report(df, length=length)) == brute(rows, length)


def test_chunks_of_a_long_text(spark, monkeypatch):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(3000)) + passage + "x" * (i * 7)) for i in range(3)]
    blob = np.frombuffer(rows[1][1].encode(), np.uint8)
    whole = R.anchors(blob, np.array([0, len(blob)]), 100)
    monkeypatch.setattr(R, "_CHUNK", 700)
    parts = R.anchors(blob, np.array([0, len(blob)]), 100)
    assert set(whole[1].tolist()) == set(parts[1].tolist())  # positions are the same, stretches may be cut
    found = R._marked(spark.createDataFrame(rows, "id long, text string"), 100).collect()
    assert {len(x.spans or []) > 0 for x in found} == {True}
    assert plain(R.repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), length=100)) == brute(rows, 100)


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_regular_strings_that_differ(spark):
    a, b = thue_morse(4096)
    rows = [(1, "start " + a + " middle"), (2, "other " + b + " middle, end"), (3, a[:2048] + "z" + b[:2048])]
    for length in (1024, 3000):
        assert plain(R.repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), length=length)) == brute(rows, length)


def test_odd_rows(spark):
    rows = [(1, "a repeated row, long enough to count here"), (1, "a repeated row, long enough to count here"), (None, "a repeated row, long enough to be other"), (1, "another text of the same id, which stays")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(R.repeat_report(df, length=20)) == brute(rows, 20)
    assert R.repeat_report(df.limit(0)).count() == 0


def test_removal_keeps_columns_and_characters(spark):
    part = "é" * 30
    rows = [(1, "first " + part + " end", "a", 1), (2, "x" + part + "y", "b", 2), (3, None, None, None), (4, "alone", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, uid int").withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in R.remove_repeats(df, length=25).collect()}
    assert R.remove_repeats(df, length=25).columns == df.columns
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == ("first  end", "xy", None, "alone")
    assert got[2].uid == 2 and got[4].lang == "c"


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert plain(R.op6_run_length_repeats(spark, sf)) == brute(rows, 400)


def test_periods_are_series():
    for text in (b"x" * 5000, b"abcdefg" * 900, b"one line of text, sixty bytes long or a few more than that.\n" * 300):
        data = np.frombuffer(text + b"unlike" + text, np.uint8)
        doc, p, lo, hi, g, s, count, way = R.anchors(data, np.array([0, len(data)]), 100)
        assert len(p) < 60 and count.sum() > len(p)
        covered = np.zeros(len(data), bool)
        for a, b, w in zip(lo, hi, way, strict=True):
            covered[a : b + w] = True
        assert covered.all()


@pytest.mark.parametrize("seed", range(4))
def test_structured_texts(spark, seed):
    r = random.Random(seed)
    piece = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 90)))
    rows = []
    for i in range(6):
        p, q = piece(), piece()
        rows.append((i, "".join(r.choice([p * r.randint(1, 9), q * r.randint(1, 9), "c", piece()]) for _ in range(12))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for length in (40, 130):
        assert plain(R.repeat_report(df, length=length)) == brute(rows, length)


def test_very_long_texts(spark):
    n = 20_000_000
    kinds = {1: F.repeat(F.lit("x"), n), 2: F.repeat(F.lit("the same line of some sixty bytes, again and again and again\n"), n // 60), 3: F.lit("short")}
    df = None
    for i, text in kinds.items():
        one = spark.range(1).select(F.lit(i).cast("long").alias("doc_id"), text.alias("text"))
        df = one if df is None else df.unionByName(one)
    got = {r.doc_id: r for r in R.repeat_report(df).drop("text").collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(n, 1), (got[2].n_bytes, 1), (0, 0)]
