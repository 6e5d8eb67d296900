import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.llm import quality as Q

SMALL = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word " * 30), (5, "a b c\na b c\n\n \nx"),
    (6, " ".join(f"wörd{i}" for i in range(40))), (7, " ".join(f"w{i}#" for i in range(40))),
    (8, " ".join(f"WORD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(40))), (6, " ".join(f"wörd{i}" for i in range(40))),
    (9, "\n".join(["one line of text here"] * 6)), (10, " ".join(f"t{i}" for i in range(19))), (11, "y" * 20000), (None, "x y"),
]


def brute(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_measures_against_brute_force(spark):
    df = spark.createDataFrame(SMALL, "doc_id long, text string").withColumn("kept", F.lit(7))
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality_report(df).collect()), key=str)
    want = []
    for i, t in SMALL:
        b = brute(t)
        want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == sorted(want, key=str)


def test_against_sql(spark, sf):
    got = sorted(map(tuple, Q.op7_quality_cascade(spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.sql(Q.ORACLES["op7_quality_cascade"]).fetchall())


def test_order_never_changes_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {tuple(sorted(r.doc_id for r in Q.quality_filter(docs, rules=rules).collect())) for rules in ((*Q.BASE_RULES, *Q.VERDICT_RULES), (*Q.VERDICT_RULES[::-1], *Q.BASE_RULES))}
    assert len(kept) == 1
    report = sorted(r.doc_id for r in Q.op7_quality_cascade(spark, sf).where("kept").collect())
    assert list(kept.pop()) == report


def test_order_by_rejection_per_cost():
    e = [Q.RuleEstimate("a", 1.0, 10, 1), Q.RuleEstimate("b", 0.1, 10, 1), Q.RuleEstimate("c", 0.1, 10, 0)]
    rules = [Q.Rule(n, None) for n in "cab"]
    assert [r.name for r in Q.cascade_order(rules, e)] == ["b", "a", "c"]


def test_short_circuit():
    import numpy as np

    from loomtab.llm.runtime import text_bytes
    import pyarrow as pa

    calls = []
    rules = [Q.Rule("first", lambda t: (calls.append(t.n), t.n_words < 2)[1]), Q.Rule("second", lambda t: (calls.append(t.n), np.zeros(t.n, bool))[1])]
    kept = Q.run_cascade(Q.Texts(*text_bytes(pa.array(["a b", "c", None, "d e f"]))), rules)
    assert kept.tolist() == [True, False, False, True] and calls == [4, 2]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_report(df).count() == 0 and Q.quality_filter(df).count() == 0


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_regular_strings_that_differ(spark):
    """Strings on which a polynomial hash modulo a power of two collides are different lines and words."""
    a, b = thue_morse(1024)
    lines, words = "\n".join([a, b]), " ".join([a, b] * 4 + [b, a] * 4)
    rows = [(1, lines), (2, words), (3, "\n".join([a, a, b]))]
    got = {r.doc_id: r for r in Q.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_dup_lines, got[3].n_dup_lines) == (0, 1)
    w = words.split()
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    assert got[2].n_repeat_words == len(covered)


def test_costs_count_what_is_known():
    texts = ["a b c " * 400, "### " * 300] * 20
    import pyarrow as pa

    from loomtab.llm.runtime import text_bytes

    given = Q.Texts(*text_bytes(pa.array(texts)))
    for m in Q.BASE:
        getattr(given, m)
    fresh = given.subset(np.arange(len(texts)))
    assert all(m in fresh.__dict__ for m in Q.BASE) and "n_upper" not in fresh.__dict__


def test_estimates_in_place(spark):
    rows = [(i, "short") for i in range(30)] + [(100 + i, "$$ word " * 30) for i in range(10)] + [(200 + i, " ".join(f"word{i}x{k}" for k in range(40))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    alone = {e.name: e for e in Q.estimate_rules(df, Q.VERDICT_RULES)}
    placed = {e.name: e for e in Q.estimate_rules(df, Q.VERDICT_RULES, after=Q.BASE_RULES, known=Q.BASE)}
    assert alone["symbols"].seen == 50 and placed["symbols"].seen == 10
    assert (alone["symbols"].rejected, placed["symbols"].rejected) == (10, 0)  # the repetitive ones are gone by then


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, long, "c", 3), (4, "some words " * 12, "d", 4), (4, "some words " * 12, "d", 4), (None, "x " * 25, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = Q.quality_report(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and [by[i].n_words for i in (1, 2, 3, 4, None)] == [0, 0, 200_000, 24, 25]
    assert by[1].base_failed and not by[1].kept and not by[3].base_failed
    assert len({tuple(r) for r in got if r.doc_id == 4}) == 1
    left = Q.quality_filter(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} <= {3, 4, None}
