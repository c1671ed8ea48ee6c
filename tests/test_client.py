"""Layers of a folder, the index at first use, catalogues and timelines in order."""

import json
from datetime import date

from pyspark.sql import functions as F

from terrane.operators import aggregates
from terrane.sources import client, tables


def test_layers_and_index(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "areas"))
    layers = client.load_all(spark, str(tmp_path), {"areas": "id long", "absent": "id long, name string"})
    assert layers["areas"].count() == 5 and layers["absent"].count() == 0 and layers["absent"].columns == ["id", "name"]
    assert spark.sql("select count(*) n from areas a left join absent b on a.id = b.id").first().n == 5
    spark.createDataFrame([("a", "x")], "id string, keys string").write.parquet(str(tmp_path / "index"))
    one = client.search_index(spark, str(tmp_path / "index"), "id string, keys string")
    assert one is client.search_index(spark, str(tmp_path / "index"), "id string, keys string") and one.is_cached and one.count() == 1
    assert client.search_index(spark, str(tmp_path / "none"), "id string").count() == 0
    one.unpersist()


def test_catalogue(spark, tmp_path):
    packages = [{"name": "p", "resources": [{"format": "SHP", "url": "u1", "size": 3}, {"format": "GDB", "url": "u2"}]}, {"name": "bare"}, {"name": "q", "resources": [{"format": None, "url": "u3"}]}]
    (tmp_path / "a.json").write_text(json.dumps({"success": True, "result": {"count": 3, "results": packages}}, indent=1))
    (tmp_path / "b.json").write_text("not json")
    assert sorted(map(tuple, tables.catalogue(spark, str(tmp_path / "*.json")).collect()), key=str) == [("p", "GDB", "u2", 1), ("p", "SHP", "u1", 0), ("q", None, "u3", 0)]


def test_rounds_by_date(spark):
    day = lambda m: date(2024, m, 1)
    rows = [(3, "x", day(1)), (1, "x", day(5)), (1, None, None), (2, "x", day(3)), (2, "y", day(3)), (2, "z", day(9)), (4, None, None)]
    long = spark.createDataFrame(rows, "round int, assessed string, dated date")
    got = aggregates.round_timeline(long).select("round", "n", "mixed").collect()
    assert [tuple(r) for r in got] == [(3, 1, False), (2, 3, True), (1, 1, False)]
    assert aggregates.round_timeline(long.where(F.lit(False))).count() == 0
