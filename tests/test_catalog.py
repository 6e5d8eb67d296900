import json

import pytest
from pyspark.sql import functions as F

from loomtab.operators import identity
from loomtab.plans import lake
from loomtab.sources.tables import DataLoadError


def test_only_queries(spark, tmp_path):
    spark.range(3).write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("kept_rows")
    try:
        for bad in (
            "with x as (select 7 as id) insert into kept_rows select id from x", "with x as (select 7 as id) from x insert into kept_rows select id insert into kept_rows select id",
            "insert into kept_rows values (1)", "select 1; drop table kept_rows", "create table z as select 1", "set a = b", "cache table kept_rows", "", "with x as (select 1) ",
        ):
            with pytest.raises(Exception):
                lake.catalog_query(spark, bad)
        assert spark.table("kept_rows").count() == 3
        assert lake.catalog_query(spark, "with x as (select id from kept_rows) select max(id) as m from (select struct(id) as s, id from x union all select struct(id), id from x)").first().m == 2
        assert lake.catalog_query(spark, "explain select 1").count() == 1
        with pytest.raises(DataLoadError):
            lake.catalog_query(spark, "with x as (select 7 as id) insert into kept_rows select id from x")
    finally:
        spark.sql("drop table kept_rows")


def test_the_catalog_lasts(spark, tmp_path):
    store = lake.Lake(spark, str(tmp_path))
    made = [store.bronze(spark.range(n).toDF("x"), {"n": n}) for n in (1, 2, 3)]
    again = lake.Lake(spark, str(tmp_path))
    assert [p["product_id"] for p in again.products()] == [p.product_id for p in reversed(made)]
    assert [p["row_count"] for p in again.products(limit=2)] == [3, 2] and again.products("silver") == []
    with store.catalog_file.open("a") as f:
        f.write('{"product_id": "to')  # a torn line
    assert len(again.products()) == 3
    store.catalog_file.unlink()
    assert again.products() == [] and again.rebuild_catalog() == 3 and len(again.products()) == 3
    assert [json.loads(x)["layer"] for x in store.catalog_file.read_text().splitlines()] == ["bronze"] * 3


def test_trees(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(500)] + [(1, "v1")] * 3, "id long, v string")
    tree = lambda x: identity.merkle_nodes(identity.digest_leaves(x, 2).cache(), 2)
    differing = lambda a, b: identity.differing_ranges(tree(a), tree(b), 2)
    assert identity.merkle_digest(df).first() == identity.merkle_digest(df.orderBy(F.desc("id")).repartition(5)).first()
    other = df.withColumn("v", F.when(F.col("id") == 77, "changed").otherwise(F.col("v")))
    found = differing(df, other).collect()
    old, new = (x.where("id = 77").select(F.substring(F.sha2(identity.canonical(x), 256), 1, 2)).first()[0] for x in (df, other))
    assert {r.prefix for r in found} == {old, new} and identity.merkle_digest(other).first().digest != identity.merkle_digest(df).first().digest
    damaged = identity.rows_of_ranges(other, spark.createDataFrame(found), 2)
    assert 77 in {r.id for r in damaged.collect()} and damaged.count() < 40
    once = differing(df.dropDuplicates(), df).collect()
    assert len(once) == 1 and once[0].n_right == once[0].n_left + 3
    empty = identity.merkle_digest(df.limit(0)).first()
    assert empty.n_rows == 0 and differing(df.limit(0), df.limit(1)).count() == 1


def test_deep_check_names_the_damage(spark, tmp_path):
    store = lake.Lake(spark, str(tmp_path))
    product = store.bronze(spark.range(40).toDF("x"), {})
    store.verify(product, deep=True)
    spark.range(40).where("id <> 7").toDF("x").write.mode("overwrite").parquet(f"{product.path}/data")
    with pytest.raises(lake.LakeError, match=r"\(1 rows, now 0\)"):
        store.verify(product, deep=True)
