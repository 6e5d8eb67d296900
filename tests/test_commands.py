import json

from loomtab.cli import main


def test_init_docs_and_catalog(spark, tmp_path, capsys):
    work, data = str(tmp_path / "work"), str(tmp_path / "d.parquet")
    spark.range(30).selectExpr("id as x", "id % 2 as y").write.parquet(data)
    say = lambda *words: (main(["--workspace", work, *words]), capsys.readouterr().out.strip())[1]
    assert say("init") == work and json.loads(say("registry")) == {}
    assert say("catalog") == ""
    product = say("ingest", "--data", data)
    assert json.loads(say("catalog"))["product_id"] == product
    assert json.loads(say("catalog", "select layer, row_count from products")) == {"layer": "bronze", "row_count": 30}
    assert say("catalog", "--rebuild") == "1" and say("verify", "bronze", product, "--deep") == "as committed"
    folder = say("docs", "--limit", "5")
    assert json.loads((tmp_path / "work" / "docs" / "catalog.json").read_text())[0]["product_id"] == product and folder.endswith("docs")
    (tmp_path / "work" / "registry.json").write_text('{"k": {}}')
    say("init")
    assert json.loads(say("registry")) == {"k": {}}
    say("init", "--force-reset-registry")
    assert json.loads(say("registry")) == {}
