from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtab.llm import url_lists as L

D = lambda day: date(2024, 1, day)
ENTRIES = [
    ("spam", "bad.example", D(2), True), ("spam", "bad.example", D(5), False), ("spam", "bad.example", D(8), True),
    ("spam", "BAD.example", D(9), True), ("ads", "x.bad.example", D(3), True), ("ads", "tie.test", D(4), False), ("ads", "tie.test", D(4), True),
    ("ads", None, D(1), True), ("ads", "void.test", None, True), ("ads", "void.test", D(1), None),
]


def brute(url, t):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "")
    host = m and m[1].rstrip(".").lower() or None
    found = []
    for name, domain in {(e[0], e[1].lower()) for e in ENTRIES if None not in e}:
        state, since = False, None
        for at in sorted({e[2] for e in ENTRIES if None not in e and (e[0], e[1].lower()) == (name, domain)}):
            if t is None or at > t:
                break
            new = max(e[3] for e in ENTRIES if None not in e and (e[0], e[1].lower(), e[2]) == (name, domain, at))
            if new and not state:
                since = at
            state = new
        if host and state and (host == domain or host.endswith("." + domain)):
            found.append((-len(domain), name, domain, since))
    return host, found and min(found)[1:] or None


def test_against_brute_force(spark):
    urls = ["http://bad.example/a", "https://u:p@X.bad.example:80/", "http://notbad.example", "http://a.x.bad.example.?q", "tie.test", "ftp://tie.test/", None, "", "http:///x", "http://void.test"]
    rows = [(i, u, t, 1) for i, (u, t) in enumerate((u, t) for u in urls for t in (None, *map(D, range(1, 11))))]
    rows.append(rows[5])
    got = L.temporal_list_join(spark.createDataFrame(rows, "page_id int, url string, fetched date, active int"), spark.createDataFrame(ENTRIES, "list_name string, domain string, at date, active boolean")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, hit = brute(r.url, r.fetched)
        assert (r.host, r.blocked) == (host, hit is not None), r
        assert ((r.list_name, r.domain, r.since) if hit else None) == hit, r


def test_empty_and_clash(spark):
    e = spark.createDataFrame(ENTRIES, "list_name string, domain string, at date, active boolean")
    c = spark.createDataFrame([("http://bad.example", D(3))], "url string, fetched date")
    assert L.temporal_list_join(c.limit(0), e).count() == 0
    assert [r.blocked for r in L.temporal_list_join(c, e.limit(0)).collect()] == [False]
    with pytest.raises(ValueError):
        L.temporal_list_join(c.withColumnRenamed("fetched", "host"), e, fetched="host")


def test_against_sql(spark, sf):
    got = L.op4_temporal_lists(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(L.ORACLES["op4_temporal_lists"])
    assert sorted(map(str, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(str, want.select(*sorted(want.columns)).fetchall()))


def test_clashing_names_and_bare_labels(spark, monkeypatch):
    entries = spark.createDataFrame([*ENTRIES, ("tld", "zip", D(2), True), ("tld", "localhost", D(1), True)], "list_name string, domain string, at date, active boolean")
    rows = [(1, "http://a.b.zip/", D(3)), (2, "http://localhost:80", D(1)), (3, "http://zip", D(1)), (4, "http://x.bad.example", D(3))]
    df = spark.createDataFrame(rows, "row int, url string, fetched date").selectExpr("*", "'x' as _hit", "'y' as _spans", "'z' as at", "7 as hit", "8 as rank", "9 as valid_from")
    for limit in (L.BROADCAST_IDS, 0):
        monkeypatch.setattr(L, "BROADCAST_IDS", limit)
        got = L.temporal_list_join(df, entries)
        assert got.columns == [*df.columns, "host", "blocked", "list_name", "domain", "since"]
        assert got.select(*df.columns).exceptAll(df).isEmpty()
        assert {r.row: (r.blocked, r.domain) for r in got.collect()} == {1: (True, "zip"), 2: (True, "localhost"), 3: (False, None), 4: (True, "x.bad.example")}


def test_large_ids(spark):
    pages = spark.createDataFrame([(2**62, "http://a.test/"), (5, None)], "page_id long, url string")
    assert [str(r.fetched) for r in L.example_captures(pages).orderBy(F.desc("page_id")).collect()] == [str(D(1) + timedelta(days=2**62 * 37 % 365)), str(D(1) + timedelta(days=185))]
