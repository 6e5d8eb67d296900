from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtab.operators import prep, splits


def times(spark, kind, n=3000):
    """Most rows in one day, a third of all in one instant."""
    day = datetime(2024, 3, 31, 1, 30)
    rows = [(i, day + timedelta(microseconds=7 * (i * 7919 % n)) if i % 3 else day + timedelta(hours=1)) for i in range(n)]
    return spark.createDataFrame(rows, "i int, t timestamp").select("i", F.col("t").cast(kind).alias("t"), F.sha2(F.col("i").cast("string"), 256).alias("row_id"))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_positions_of_one_day(spark, kind):
    df = times(spark, kind)
    rows = splits.positions(df, [F.col("t"), F.col("row_id")], hexed_ties=True).collect()
    want = sorted(rows, key=lambda r: (r.t, r.row_id))
    assert [r.pos for r in want] == list(range(len(rows)))


def test_a_day_and_an_instant_are_spread(spark, monkeypatch):
    seen = []
    plain = splits.Window.partitionBy
    monkeypatch.setattr(splits.Window, "partitionBy", staticmethod(lambda *c: (seen.append(c), plain(*c))[1]))
    df = times(spark, "timestamp_ntz").withColumn("_o0", F.col("t")).withColumn("_o1", F.col("row_id"))
    key = splits._spread(df)
    found = splits._quantiles(df, key)
    assert len(set(found)) > 100 and sum(a == b for a, b in zip(found, found[1:], strict=False)) > 50
    members = splits.time_split(times(spark, "timestamp_ntz"), "t", 3)
    assert members.where("role = 'validation'").count() == 3 * 750


def test_written_times_never_fall(spark):
    moments = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1), datetime(2024, 3, 31, 2, 30), datetime(2024, 3, 31, 3, 0), datetime(2024, 10, 27, 2, 30, 0, 1), datetime(2024, 10, 27, 3, 0)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, _o0 timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(splits._spread(df)).collect()]
    assert got == [round((m - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for m in moments]


def test_callers_names_and_release(spark, monkeypatch):
    monkeypatch.setattr(prep, "INLINE_CODES", 3)
    df = spark.createDataFrame([(f"s{i % 9}", i, i % 4) for i in range(60)], "c string, _v0 int, _c0 int")
    model = prep.fit_prep(df)
    out = model.transform(df)
    assert {r.c for r in out.collect()} == set(range(9)) and {"_v0", "_c0"} <= set(out.columns)
    assert model.tables["c"][0].is_cached
    model.release()
    assert not model.tables["c"][0].is_cached
