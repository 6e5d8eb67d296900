import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomtab.sources.events import EventLog, stream_events
from loomtab.sources.tables import DataLoadError, load_sqlite


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as con:
        con.execute('create table t (id integer primary key, name varchar(20), price real, raw blob, "odd ""name" , mixed)')
        con.executemany("insert into t values (?, ?, ?, ?, ?, ?)", [(i, f"n{i}" if i % 7 else None, i / 4, bytes([i % 256]), i, i if i % 2 else i / 2) for i in range(3, 20_003)])
        con.execute("insert into t values (99999999, 5, 'text', 'blob', null, null)")
        con.execute("create table empty (a int, b text)")
    return path


def test_tables_in_ranges(spark, database):
    df = load_sqlite(spark, database, table="t", partitions=6)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "price": "double", "raw": "binary", 'odd "name': "bigint", "mixed": "double"}
    assert df.agg(F.count(F.lit(1)), F.countDistinct("id"), F.sum("price")).first() == (20_001, 20_001, sum(i / 4 for i in range(3, 20_003)))
    assert df.rdd.getNumPartitions() == 6
    assert tuple(df.where("id = 99999999").first()) == (99999999, "5", None, bytearray(b"blob"), None, None)
    assert load_sqlite(spark, database, table="empty").count() == 0 and load_sqlite(spark, database, table="empty").columns == ["a", "b"]


def test_queries_by_one_task(spark, database):
    df = load_sqlite(spark, database, "select id % 3 as k, count(*) as n, avg(price) as p, max(name) as m from t where id < 1000 group by 1;")
    assert dict(df.dtypes) == {"k": "bigint", "n": "bigint", "p": "double", "m": "string"} and sorted(r.n for r in df.collect()) == [332, 332, 333]
    for bad in ("delete from t", "select 1; select 2", "select * from missing"):
        with pytest.raises(DataLoadError):
            load_sqlite(spark, database, bad)
    with pytest.raises(DataLoadError):
        load_sqlite(spark, database)


def test_each_event_once_over_rotations(spark, tmp_path):
    log = EventLog(str(tmp_path / "e.jsonl"), max_bytes=2000, backups=5)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def taken():
        q = stream_events(spark, str(log.path)).writeStream.format("parquet").option("checkpointLocation", state).start(out)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r.n_rows for r in spark.read.parquet(out).collect())

    add = lambda a, b: [log.append({"event": "x", "run_id": "r", "n_rows": i, "cv_scores": {"auc": 0.5}, "config": {"k": i}, "params": {"p": i}}) for i in range(a, b)]
    add(0, 12)
    with log.path.open("a") as f:
        f.write('{"event": "x", "n_ro')  # a torn tail
    assert taken() == list(range(12))
    with log.path.open("a") as f:
        f.write('ws": 12}\n\n')
    add(13, 40)  # rotates twice or more
    assert len(log.files()) > 2 and taken() == list(range(40))
    assert taken() == list(range(40))
    row = spark.read.parquet(out).where("n_rows = 39").first()
    assert row.cv_scores == {"auc": 0.5} and json.loads(row.config) == {"k": 39} and row.params == {"p": "39"}


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"event": "a"}\nnot json\n[1]\n{"event": "b", "n_rows": "many"}\n')

    def run(on_error):
        q = stream_events(spark, str(tmp_path / "e.jsonl"), on_error=on_error).writeStream.format("memory").queryName(f"q_{on_error}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run("skip")
    assert sorted((r.event, r.n_rows) for r in spark.table("q_skip").collect()) == [("a", None), ("b", None)]
    with pytest.raises(Exception, match="malformed"):
        run("raise")
