"""A gold product stores each row once; its features, labels and splits are those of the separate operators."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtab.operators import models, splits
from loomtab.operators.identity import row_id_parts, with_row_ids
from loomtab.operators.profile import Contract
from loomtab.plans.lake import Lake


@pytest.fixture
def silver(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 700).cast("double").alias("x"), (F.col("id") % 11).cast("string").alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).cast("int").alias("y"))
    df = df.withColumn("t", F.col("x") * 4 + F.crc32("g") % 4)
    store = Lake(spark, str(tmp_path))
    return store, store.silver(store.bronze(df, {}), Contract())


def same(a, b):
    return sorted(a.columns) == sorted(b.columns) and a.select(b.columns).exceptAll(b).isEmpty() and a.count() == b.count()


def test_a_row_is_stored_once(spark, silver):
    store, product = silver
    rows = with_row_ids(product.table(spark, "data"))
    gold = store.gold(product, "y", folds=3)
    assert same(gold.table(spark, "features"), rows.drop("y")) and same(gold.table(spark, "labels"), rows.select("row_id", "y"))
    assert same(gold.table(spark, "splits"), splits.stratified(rows, "y", 3))
    # 64 digits of an id came in features, labels and three times in splits, 190,000 bytes and more each
    assert sum(p.stat().st_size for p in Path(gold.path).rglob("*.parquet") if "trees" not in p.parts) < 60 * 3000
    assert {n: t["row_count"] for n, t in gold.manifest["tables"].items()} == {"features": 3000, "labels": 3000, "splits": 9000}
    store.verify(gold, deep=True)
    assert store.gold(product, "y", folds=3).manifest == gold.manifest and store.products("gold")[0]["row_count"] == 15000


@pytest.mark.parametrize(("strategy", "options", "want"), [
    ("kfold", {"folds": 4}, lambda r: splits.kfold(r, 4)),
    ("kfold", {"folds": 4, "seed": 5}, lambda r: splits.kfold(r, 4, 5)),
    ("stratified", {"folds": 2, "seed": 3}, lambda r: splits.stratified(r, "y", 2, 3)),
    ("group", {"folds": 3, "column": "g"}, lambda r: splits.group_kfold(r, "g", 3)),
])
def test_splits_of_gold(spark, silver, strategy, options, want):
    store, product = silver
    gold = store.gold(product, "y", strategy, **options)
    assert same(gold.table(spark, "splits"), want(with_row_ids(product.table(spark, "data"))))


def test_rows_in_no_fold_are_kept(spark, tmp_path):
    store = Lake(spark, str(tmp_path))
    silver = store.silver(store.bronze(spark.range(40).select("id", (F.col("id") % 2).alias("y")), {}), Contract())
    gold = store.gold(silver, "y", "purged_time", folds=3, column="id", gap=2, embargo=1)
    assert same(gold.table(spark, "splits"), splits.time_split(with_row_ids(silver.table(spark, "data")), "id", 3, 2, 1))
    assert gold.table(spark, "features").count() == 40
    with pytest.raises(splits.SplitError):
        store.gold(silver, "y", "kfold", folds=41)
    assert len(list(tmp_path.glob("gold/*"))) == 1


def test_listed_memberships_are_checked(spark):
    schema = "row_id string, s array<struct<fold: smallint, role: string, repeat: smallint>>"
    a, b = f"{1:064x}", f"{2:064x}"
    good = [(a, [(0, "train", 0), (1, "validation", 0)]), (f"{3:064x}"[::-1], [(0, "validation", 0), (1, "train", 0)])]
    assert splits.validate_listed(spark.createDataFrame(good, schema), "s") == (2, 4)
    # ids that agree in their first digits only are different
    assert splits.validate_listed(spark.createDataFrame([*good, (b, good[0][1])], schema), "s") == (3, 6)
    for bad, what in (([*good, good[0]], "repeated rows"), ([*good, (b, [(0, "train", 0), (0, "validation", 0)])], "both sides"), ([*good, (b, [(0, "train", 0)] * 2)], "repeated rows"), (good[:1], "one role"), ([*good, (b, [(0, "odd", 0)])], "unknown"), ([(a, [])], "no rows")):
        with pytest.raises(splits.SplitError, match=what):
            splits.validate_listed(spark.createDataFrame(bad, schema), "s")


def test_ids_in_parts(spark):
    df = spark.createDataFrame([(float(i % 9), {"k": i % 9}, None if i % 2 else "a") for i in range(200)], "x double, m map<string, int>, s string")
    parts = row_id_parts(df, 4)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    assert sorted(r.row_id for r in whole.collect()) == sorted(r.row_id for r in with_row_ids(df).collect())


def test_folds_of_stored_rows(spark, silver):
    store, product = silver
    gold = store.gold(product, "y", "kfold", folds=2)
    rows = gold.table(spark, "rows").na.fill(0, ["y"])
    run = lambda df, m: models.cross_validate(df, ["x"], "y", models.make_model("linear", "classification"), ["accuracy"], membership=m)
    assert run(rows, "splits") == run(rows.drop("splits"), gold.table(spark, "splits"))
    assert json.loads((store.root / "gold" / gold.product_id / "manifest.json").read_text())["tables"]["splits"]["inline"] == "splits"
