"""Small literal frames: preparation, drift, contracts, splits, events, lake, session."""

import datetime
import json
import math
import sqlite3

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtab.functions.scalars import normal_name, safe_ratio
from loomtab.functions.special import chi2_p_value, gamma_q, ks_p_value
from loomtab.operators import audit, drift, features, identity, metrics, models, prep, profile, search, splits
from loomtab.plans import lake, reporting
from loomtab.session import ExperimentConfig, ExperimentSession
from loomtab.sources import events as E
from loomtab.sources import tables as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- sources


def test_load_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;a\n".replace(";", ","))
    assert T.load_data(spark, str(tmp_path / "a.csv")).collect()[0].x == 1
    frame(spark, [(1,)], "x int").write.parquet(str(tmp_path / "b.parquet"))
    assert T.load_data(spark, str(tmp_path / "b.parquet")).count() == 1
    for bad in ("c.txt", "none.parquet"):
        with pytest.raises(T.DataLoadError):
            T.load_data(spark, str(tmp_path / bad))


def test_sqlite_reads_only(spark, tmp_path):
    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as con:
        con.execute("create table t (a integer, b text, c real)")
        con.executemany("insert into t values (?, ?, ?)", [(1, "x", 0.5), (None, None, 2)])
    assert [tuple(r) for r in T.load_sqlite(spark, db, "select * from t;").collect()] == [(1, "x", 0.5), (None, None, 2.0)]
    for bad in ("drop table t", "select 1; select 2", "select 'please DROP it'", "update t set a = 1", "select * from none"):
        with pytest.raises(T.DataLoadError):
            T.load_sqlite(spark, db, bad)


def test_written_artifact_is_described(spark, tmp_path):
    df = spark.range(10)
    a = T.write_parquet(df, str(tmp_path / "p"))
    assert a.row_count == 10 and a.size > 0 and len(a.digest) == 64
    assert T.describe_parquet(spark, a.path).digest == a.digest


def test_event_log_torn_tail(spark, tmp_path):
    log = E.EventLog(str(tmp_path / "e.jsonl"))
    for i in range(3):
        log.append({"event": "model_completed", "run_id": f"r{i}", "cv_scores": {"roc_auc": 0.5 + i / 10}, "timestamp": f"2024-01-0{i + 1}T00:00:00"})
    with open(log.path, "a") as f:
        f.write("\n" + '{"event": "model_comp')
    assert E.read_events(spark, str(log.path), "skip_trailing").count() == 3
    assert E.read_events(spark, str(log.path), "skip").count() == 3
    with pytest.raises(E.EventLogError):
        E.read_events(spark, str(log.path)).count()
    with open(log.path, "a") as f:
        f.write("\n" + json.dumps({"event": "late"}) + "\n")
    with pytest.raises(E.EventLogError):
        E.read_events(spark, str(log.path), "skip_trailing")


def test_event_log_rotates(tmp_path):
    log = E.EventLog(str(tmp_path / "e.jsonl"), max_bytes=60, backups=2)
    for i in range(6):
        log.append({"event": "x", "n": i, "pad": "p" * 20})
    assert len(log.files()) == 3
    assert log.finalize().endswith(".gz")


# ---- preparation


def test_fills_dates_and_codes(spark):
    df = frame(spark, [(1.0, "a", datetime.date(2023, 1, 15), 0), (None, "a", datetime.date(2023, 6, 20), 1), (3.0, None, None, 1), (float("nan"), "b", None, None)], "num double, cat string, event_date date, target int")
    model = prep.fit_prep(df, "target")
    out = model.transform(df)
    assert out.columns == ["target", "num", "cat", "event_year", "event_month", "event_day", "event_weekday"]
    rows = out.collect()
    assert [r.num for r in rows] == [1.0, 2.0, 3.0, 2.0] and [r.cat for r in rows] == [0, 0, 0, 1]
    assert (rows[0].event_year, rows[0].event_weekday) == (2023, 7) and rows[3].target is None
    new = model.transform(frame(spark, [(None, "zzz", None, 0)], "num double, cat string, event_date date, target int")).first()
    assert (new.num, new.cat) == (2.0, 2)


def test_mode_ties_take_the_smallest(spark):
    assert prep.modes(frame(spark, [("b",), ("a",), (None,), (None,), (None,)], "c string"), ["c"]) == {"c": "a"}


def test_prep_errors(spark):
    df = frame(spark, [("y", 1), ("n", 2), (None, 3)], "t string, x int")
    for f in (lambda: prep.drop_columns(df, ["q"]), lambda: prep.drop_columns(df, ["t"], "t"), lambda: prep.orient_target(df, "t", "y"), lambda: prep.orient_target(df.dropna(), "t", "z")):
        with pytest.raises(prep.PrepError):
            f()


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(allow_nan=True), st.floats(allow_nan=True)), min_size=1, max_size=20))
def test_ratio_is_finite_or_large(spark, rows):
    got = frame(spark, rows, "a double, b double").select(safe_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r is not None and math.isfinite(r.r) for r in got)


def test_names():
    assert normal_name("Größe (cm)") == "gr__e__cm_" and normal_name("1st")[0].isalpha() and len(normal_name("x" * 99)) == 64


# ---- drift


def one(spark, values, kind="double"):
    return frame(spark, [(v,) for v in values], f"a {kind}")


def test_ks_and_psi(spark):
    same = one(spark, [float(i % 5) for i in range(100)])
    report = drift.drift_report(same, same)
    assert len(report.columns) == 1 and not report.drift_detected and report.columns[0].p_value == 1.0
    assert drift.drift_report(one(spark, [0.0] * 100), one(spark, [10.0] * 100)).drift_detected
    assert drift.drift_report(one(spark, [1.0, 2.0]), one(spark, [])).columns[0].p_value == 1.0
    gaps = one(spark, [1.0, None, float("nan"), 2.0, 3.0])
    assert drift.ks_statistics(gaps, gaps).first().n_ref == 3
    r = np.random.default_rng(0)
    a, b = one(spark, r.normal(0, 1, 1000).tolist()), one(spark, r.normal(5, 1, 1000).tolist())
    assert drift.psi_report(a, b).first().psi > 0.25 and drift.psi_report(a, a).first().psi == 0.0
    assert drift.psi_report(one(spark, [0.0] * 500), one(spark, [10.0] * 500)).first().level == "severe"
    assert drift.psi_report(a, one(spark, [])).first().psi == 0.0
    assert drift.detect(a, b, "both")["auc"] > 0.9 and drift.detect(a, b, "psi")["drift_detected"]


def test_ks_statistic_against_numpy(spark):
    r = np.random.default_rng(3)
    x, y = np.round(r.normal(0, 1, 700), 2), np.round(r.normal(0.2, 1.2, 500), 2)
    grid = np.unique(np.concatenate([x, y]))
    d = max(abs((x <= v).mean() - (y <= v).mean()) for v in grid)
    assert drift.ks_statistics(one(spark, x.tolist()), one(spark, y.tolist())).first().d == pytest.approx(d)


def test_chi2(spark):
    a, b = one(spark, ["A"] * 80 + ["B"] * 20, "string"), one(spark, ["A"] * 20 + ["B"] * 80, "string")
    r = drift.chi2_statistics(a, b, ["a"]).first()
    assert r.dof == 1 and r.statistic == pytest.approx(69.62) and drift.drift_report(a, b).drift_detected
    assert drift.drift_report(a, a).columns[0].p_value == 1.0


def test_p_values():
    assert chi2_p_value(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_p_value(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-6)
    assert gamma_q(1.0, 2.0) == pytest.approx(math.exp(-2))
    assert ks_p_value(1.0, 3, 3) == pytest.approx(0.1)  # 2 of 20 orders separate the samples
    assert ks_p_value(0.0, 50, 60) == 1.0
    assert ks_p_value(0.03, 4000, 4000) == pytest.approx(0.0547, abs=3e-3)


# ---- profile, contracts, identity


def test_contract(spark):
    df = frame(spark, [(1, 1.0, 0), (1, None, 1)], "record long, feature double, target int")
    found = profile.Contract({"record": "int64", "feature": "string", "gone": "int64"}, ["record"], {"default": 0.4}).problems(df)
    assert len(found) == 4
    profile.Contract({"record": "int64"}, [], {"feature": 0.5}).check(df)


def test_preflight(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.rand(1).alias("a"), (F.col("id") % 2).cast("int").alias("target"))
    assert [i.code for i in profile.preflight(df, "target", "classification")] == ["id_like"]
    assert profile.preflight(df, "gone", "classification")[0].code == "missing_target"
    rare = spark.range(30).select(F.rand(2).alias("a"), (F.col("id") >= 2).cast("int").alias("target"))
    assert "rare_for_folds" in [i.code for i in profile.preflight(rare, "target", "classification", strategy="stratified")]
    assert "few_folds" in [i.code for i in profile.preflight(df, "target", "classification", folds=1)]


def test_row_ids_and_digest_ignore_order(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (2, None), (2, "null")], "x int, y string")
    ids = {r.row_id for r in identity.with_row_ids(df).collect()}
    assert len(ids) == 4 and ids == {r.row_id for r in identity.with_row_ids(df.orderBy(F.desc("x"), "y").repartition(3)).collect()}
    assert identity.frame_digest(df).first() == identity.frame_digest(df.repartition(3)).first()
    assert identity.frame_digest(df).first().digest != identity.frame_digest(df.dropDuplicates()).first().digest


# ---- splits


def ids(spark, n):
    return spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("row_id"), F.col("id").alias("time"), (F.col("id") % 3).alias("y"), (F.col("id") % 7).alias("g"))


def test_splits(spark):
    rows = ids(spark, 103)
    for members in (splits.kfold(rows, 4), splits.kfold(rows, 4, seed=1), splits.stratified(rows, "y", 4), splits.stratified(rows, "y", 4, seed=2), splits.group_kfold(rows, "g", 4)):
        splits.validate_split(members)
        sizes = [r.n for r in splits.fold_counts(members).where("role = 'validation'").collect()]
        assert sum(sizes) == 103
    assert max(sizes) - min(sizes) <= 30
    again = splits.kfold(rows.orderBy(F.desc("time")).repartition(5), 4)
    assert splits.kfold(rows, 4).exceptAll(again).isEmpty()


def test_time_split_and_embargo(spark):
    rows = ids(spark, 20)
    plain, purged = splits.time_split(rows, "time", 3), splits.time_split(rows, "time", 3, embargo=2)
    size = lambda m: [r.n for r in splits.fold_counts(m).where("role = 'train'").orderBy("fold").collect()]
    assert [a - b for a, b in zip(size(plain), size(purged), strict=True)] == [2, 2, 2]
    splits.validate_time_split(plain, rows, "time")
    tied = rows.withColumn("time", F.lit(1))
    with pytest.raises(splits.SplitError):
        splits.validate_time_split(splits.time_split(tied, "time", 3), tied, "time")
    with pytest.raises(splits.SplitError):
        splits.time_split(rows.withColumn("time", F.when(F.col("time") > 3, F.col("time"))), "time", 3)


def test_bad_splits(spark):
    for rows in ([], [("a", 0, "train", 0), ("a", 0, "validation", 0)], [("a", 0, "train", 0), ("a", 0, "train", 0), ("b", 0, "validation", 0)], [("a", 0, "odd", 0)], [("a", 0, "train", 0)]):
        with pytest.raises(splits.SplitError):
            splits.validate_split(frame(spark, rows, "row_id string, fold int, role string, repeat int"))


# ---- metrics and models


def test_auc_against_counting(spark):
    r = np.random.default_rng(5)
    y, s = r.integers(0, 2, 300), np.round(r.random(300), 1)
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y == 1] for b in s[y == 0]]
    df = frame(spark, list(zip(y.tolist(), s.tolist(), strict=True)), "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(float(np.mean(pairs)))
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def data(spark, n=400, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(0, 0.5, n) > 0).astype(int)
    return frame(spark, [(str(i), *map(float, row), int(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "row_id string, a double, b double, c double, y int")


def test_ridge_against_closed_form(spark):
    df = data(spark)
    m = np.array([tuple(r) for r in df.select("a", "b", "c").collect()])
    x, y = m[:, :2], m[:, 2]
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    want = xc @ w + y.mean()
    got = models.ridge()(df, ["a", "b"], "c")(df).select("prediction").collect()
    assert np.allclose([r[0] for r in got], want)


def test_models_and_audits(spark):
    df = data(spark).cache()
    x = ["a", "b", "c"]
    cv = models.cross_validate(df, x, "y", models.logistic(), ["roc_auc", "accuracy"], folds=3, workers=2)
    assert cv["roc_auc"][0] > 0.85
    member = splits.kfold(df, 3)
    assert models.cross_validate(df, x, "y", models.logistic(), ["roc_auc"], membership=member)["roc_auc"][0] > 0.85
    leaky = df.withColumn("leak", F.col("y") + 0.0)
    assert [f.feature for f in audit.leakage_audit(leaky, ["b", "c", "leak"], "y", "classification", folds=2)] == ["leak"]
    noisy = df.withColumn("y", F.when(F.col("row_id").cast("int") % 10 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    report = audit.label_noise(noisy, x, "y")
    found = {r.row_id for r in report.scores.where("is_issue").collect()}
    assert 0.3 < len([i for i in found if int(i) % 10 == 0]) / max(len(found), 1)
    assert audit.drop_noise(noisy, report.scores).count() < noisy.count()
    assert not audit.label_noise(df.withColumn("y", F.lit(1)), x, "y").enabled
    top = features.top_features(features.permutation_importance(df, x, "y", models.logistic(), "roc_auc", 1), 1)
    assert top == ["a"]
    platt = models.fit_calibrator(df, x, "y", models.logistic(), "platt", 2)
    iso = models.fit_calibrator(df, x, "y", models.logistic(), "isotonic", 2)
    for c in (platt, iso):
        p = df.limit(20).select(c.apply(F.lit(0.9)).alias("p"), c.apply(F.lit(0.1)).alias("q")).first()
        assert 0 <= p.q < p.p <= 1
    with pytest.raises(models.ModelError):
        models.measure(models.ridge()(df, x, "y")(df), "y", ["roc_auc"])


def test_permuted_keeps_the_values(spark):
    df = data(spark, 50)
    p = features.permuted(df, "a", 1)
    assert sorted(r.a for r in p.collect()) == sorted(r.a for r in df.collect()) and p.exceptAll(df).count() > 20


def test_target_transform_round_trip(spark):
    r = np.random.default_rng(1)
    for values, kind in ((np.exp(r.normal(size=300)), "box_cox"), (np.exp(r.normal(size=300)) - 1, "yeo_johnson"), (r.normal(size=300), "none")):
        df = one(spark, values.tolist())
        t = features.fit_target_transform(df, "a")
        assert t.kind == kind
        back = df.select("a", t.inverse(t.forward(F.col("a"))).alias("b")).collect()
        assert np.allclose([x.a for x in back], [x.b for x in back], atol=1e-6)
        if kind != "none":
            assert abs(features.skewness(df.select(t.forward(F.col("a")).alias("a")), "a")) < 0.5


def test_search():
    best, trials = search.search(lambda s: -((s["x"] - 3) ** 2), {"x": ("float", 0, 6), "z": [1, 2]}, "roc_auc", 40)
    assert abs(best.settings["x"] - 3) < 0.6 and search.importances(trials)["x"] > 0.5
    with pytest.raises(search.SearchError):
        search.search(lambda s: 1 / 0, {"x": ("int", 0, 1)}, "r2", 3)


def test_encodings(spark):
    df = frame(spark, [("a", 1.0), ("a", 0.0), ("b", 1.0), (None, 0.0)], "c string, y double")
    table = features.fit_frequency_encoding(df, "c", "y")
    wide = features.augment(df.union(frame(spark, [("new", 1.0)], "c string, y double")), ["c"], {"c": table})
    assert wide.columns == ["y", "c_emb_0", "c_emb_1"] and wide.where("c_emb_0 = 0").count() == 1
    assert len(features.fit_pca(df.dropna(), ["c"], 2)(df.dropna()).first()._pca) == 2


# ---- lake, reports, session


def test_lake(spark, tmp_path):
    df = spark.range(12).select(F.col("id").alias("feature"), (F.col("id") % 2).alias("target"))
    store = lake.Lake(spark, str(tmp_path))
    bronze = store.bronze(df, {"name": "t"})
    assert store.bronze(df.orderBy(F.desc("feature")), {"name": "t"}).product_id == bronze.product_id
    silver = store.silver(bronze, profile.Contract({"feature": "int64"}, ["feature"]))
    with pytest.raises(profile.ContractError):
        store.silver(bronze, profile.Contract({"gone": "int64"}))
    gold = store.gold(silver, "target", folds=3)
    assert gold.manifest["strategy"] == "stratified"
    with pytest.raises(splits.SplitError):
        store.gold(silver, "target", "time")
    platinum = store.platinum(gold, {"roc_auc": 0.5})
    store.catalog()
    assert lake.catalog_query(spark, "select count(*) as n from products").first().n == 4
    for bad in ("drop table x", "select 1; select 2", "insert into products values (1)", "with x as (select 1) insert into products select * from x"):
        with pytest.raises(Exception):
            lake.catalog_query(spark, bad)
    up = {r.product_id for r in lake.lineage_closure(spark.table("lineage"), platinum.product_id).collect()}
    assert up == {bronze.product_id, silver.product_id, gold.product_id}
    (tmp_path / "bronze" / ".left").mkdir()
    assert len(store.collect_garbage()) == 1 and store.collect_garbage(False) and not store.collect_garbage()
    part = next((tmp_path / "bronze" / bronze.product_id / "data").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(lake.LakeError):
        store.bronze(df, {"name": "t"})


def test_registry(tmp_path):
    r = reporting.Registry(str(tmp_path / "r.json"))
    entry = lambda s, m="roc_auc": {"model": "x", "run_id": "1", "score": s, "metric_name": m, "artifact_path": "", "registered_at": ""}
    assert r.promote("k", entry(0.8)) and not r.promote("k", entry(0.8)) and r.promote("k", entry(0.9)) and not r.promote("k", entry(0.1, "rmse"))
    assert r.promote("l", entry(3.0, "rmse")) and r.promote("l", entry(2.0, "rmse")) and not r.promote("l", entry(2.5, "rmse"))


def test_session(spark, tmp_path):
    s = ExperimentSession(spark, str(tmp_path))
    df = data(spark, 200).drop("row_id")
    board = s.run(ExperimentConfig("y", models=("linear",), folds=2), df).collect()
    assert [r.model for r in board][0] == "linear" and s.registry.load()
    assert "Leaderboard" in s.state()
    assert not s.drift_check(df, df)["drift_detected"]
    out = s.medallion_run(df, "y", folds=2)
    assert s.medallion_run(df, "y", folds=2) == out


def test_streaming_psi(spark, tmp_path):
    from loomtab.streaming.drift import monitor_psi, windowed_profile

    rows = spark.range(200).select(F.col("id").cast("double").alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    monitor_psi(stream, rows, str(tmp_path / "cp"), lambda n, r: seen.extend(r.collect()), ["v"]).awaitTermination(60)
    assert [x.psi for x in seen] == [0.0]
    q = windowed_profile(stream, "t", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from w").first()[0] == 200
