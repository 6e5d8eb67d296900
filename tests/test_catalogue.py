"""Every registered query of the core against its SQL, as the driver compares them."""

import datetime
import decimal
import math

import duckdb
import pytest

from loomtab.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"gbt_cv", "hpo_search", "medallion_run", "calibration", "leakage_audit", "interaction_discovery", "noise_audit", "linear_baseline_cv", "ridge_baseline_cv"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert len(x) == len(y) and all(p == q or (isinstance(p, float) and isinstance(q, (int, float)) and math.isclose(p, q, abs_tol=1e-9)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
