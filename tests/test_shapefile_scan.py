"""One archive read by many tasks, with attributes and boxes pruned."""

import contextlib
import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.sources import shapefile
from tests.test_sources import WGS, dbf, poly, shp


def square(x, y, size):
    ring = [(x, y), (x, y + size), (x + size, y + size), (x + size, y), (x, y)]
    body = bytearray(poly(5, [ring]))
    struct.pack_into("<4d", body, 4, x, y, x + size, y + size)
    return bytes(body)


def archive(path, n, compression, index=True):
    rng = random.Random(n)
    bodies, rows = [], []
    for k in range(n):
        bodies.append(struct.pack("<i", 0) if k % 17 == 5 else square(rng.uniform(0, 90), rng.uniform(0, 40), rng.uniform(0.1, 2)))
        rows.append((f"name {k}", k, "20240229" if k % 3 else "2024"))
    content, places, at = shp(bodies), [], 100
    for b in bodies:
        places.append(struct.pack(">ii", at // 2, len(b) // 2))
        at += 8 + len(b)
    with zipfile.ZipFile(path, "w", compression) as z:
        z.writestr("in/LAYER.shp", content)
        if index:
            z.writestr("in/layer.shx", b"\0" * 100 + b"".join(places))
        z.writestr("in/layer.dbf", dbf([("NAME", "C", 12), ("K", "N", 8), ("DAY", "D", 8)], rows))
        z.writestr("in/layer.prj", WGS)
        z.writestr("in/other.shp", b"")
    return str(path)


@pytest.mark.parametrize("compression", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_many_tasks_read_what_one_reads(spark, tmp_path, compression):
    path = archive(tmp_path / "a.zip", 400, compression)
    one = shapefile.read(spark, path, "layer", "EPSG:4326", split_bytes=1 << 30)
    many = shapefile.read(spark, path, "layer", "EPSG:4326", split_bytes=4000)
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 10
    rows = lambda df: sorted((r.ord, str(r.attributes), str(r.geom)) for r in df.collect())
    assert rows(one) == rows(many) and len(rows(one)) == sum(k % 17 != 5 for k in range(400))
    tasks = many.select("ord", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).orderBy("p").collect()
    assert len(tasks) > 10 and all(a.b < b.a for a, b in zip(tasks, tasks[1:]))
    attributes = {r.ord: r.attributes for r in many.collect()}
    assert attributes[7] == {"NAME": "name 7", "K": "7", "DAY": "2024-02-29"} and attributes[3]["DAY"] is None
    # without an index one task reads all
    bare = shapefile.read(spark, archive(tmp_path / "b.zip", 400, compression, index=False), "layer", "EPSG:4326", split_bytes=4000)
    assert bare.rdd.getNumPartitions() == 1 and rows(bare) == rows(one)


def test_columns_and_boxes(spark, tmp_path):
    for name in ("a.zip", "b.zip"):
        path = archive(tmp_path / name, 300, zipfile.ZIP_DEFLATED)
    both = shapefile.scan(spark, str(tmp_path / "*.zip"), "layer", "EPSG:4326", split_bytes=5000)
    meets = "x1 >= 10 and x0 <= 30 and y1 >= 5 and y0 <= 20"
    want = sorted(r.ord for r in both.where(meets).collect())
    got = shapefile.read(spark, str(tmp_path / "*.zip"), "layer", "EPSG:4326", columns=["K"], box=(10, 5, 30, 20), split_bytes=5000)
    assert sorted(r.ord for r in got.collect()) == want and 0 < len(want) < both.count()
    assert all(r.attributes == {"K": str(r.ord)} for r in got.collect())
    assert all(r.attributes == {} for r in shapefile.read(spark, path, "layer", "EPSG:4326", columns=[]).collect())
    # and as filters that Spark pushes
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = shapefile.scan(spark, path, "layer", "EPSG:4326").where(meets + " and x0 > 11")
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            pushed.explain("formatted")
        assert "GreaterThanOrEqual(x1,10.0)" in plan.getvalue().split("PushedFilters")[1]
        assert sorted(r.ord for r in pushed.collect()) == sorted(r.ord for r in shapefile.scan(spark, path, "layer", "EPSG:4326").collect() if r.x1 >= 10 and 11 < r.x0 <= 30 and r.y1 >= 5 and r.y0 <= 20)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_layers_that_are_absent_or_empty(spark, tmp_path):
    path = archive(tmp_path / "a.zip", 0, zipfile.ZIP_STORED)
    assert shapefile.read(spark, path, "layer", "EPSG:4326").count() == 0
    assert shapefile.read(spark, path, "absent", "EPSG:4326").count() == 0


def test_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    path = archive(tmp_path / "a.zip", 50, zipfile.ZIP_DEFLATED)
    want = sorted(r.ord for r in shapefile.read(spark, path, "layer", "EPSG:4326").collect())
    monkeypatch.setattr(shapefile, "SEEKABLE", ())
    assert sorted(r.ord for r in shapefile.read(spark, path, "layer", "EPSG:4326").collect()) == want
