"""Readers and writers on files made here."""

import io
import json
import struct
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrane.functions import crs
from terrane.functions import geometry as G
from terrane.operators import provenance
from terrane.sources import geojson, html, shapefile, sinks, tables
from terrane.streaming import crawl

WGS = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]'
CW = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
CCW_HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


def shp(records):
    body = b""
    for k, content in enumerate(records, 1):
        body += struct.pack(">ii", k, len(content) // 2) + content
    return b"\0" * 100 + body


def poly(kind, rings):
    points = [p for r in rings for p in r]
    starts, n = [], 0
    for r in rings:
        starts.append(n)
        n += len(r)
    return struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(rings), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in points)


def dbf(fields, rows):
    head = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, t, w in fields) + b"\r"
    size = 1 + sum(w for _, _, w in fields)
    body = b"".join(b" " + b"".join(str(v).encode()[:w].ljust(w) for v, (_, _, w) in zip(r, fields)) for r in rows)
    return struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rows), 32 + len(head), size) + head + body


def archive(path, prj=WGS):
    records = [poly(5, [CW, CCW_HOLE, [(0, 0), (1, 1), (0, 0)]]), struct.pack("<i", 0), poly(3, [[(0, 0), (1, 1)]]), struct.pack("<idd", 1, 7.0, 8.0)]
    rows = [("one", "20240229"), ("gone", ""), ("line", "x"), ("point", "20200101")]
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("Dir/Layer.SHP", shp(records))
        z.writestr("Dir/Layer.dbf", dbf([("NAME", "C", 10), ("DAY", "D", 8)], rows))
        z.writestr("Dir/Layer.prj", prj)
    path.write_bytes(blob.getvalue())
    return str(path)


def test_zipped_shapefile(spark, tmp_path):
    path = archive(tmp_path / "a.zip")
    rows = {r.ord: r for r in shapefile.read(spark, path, "layer", "EPSG:4326").collect()}
    assert sorted(rows) == [0, 2, 3]  # a null shape is skipped
    assert rows[0].geom.kind == "Polygon" and [len(r) for r in rows[0].geom.parts[0]] == [5, 5]
    assert rows[0].attributes == {"NAME": "one", "DAY": "2024-02-29"} and rows[2].attributes["DAY"] is None
    assert rows[2].geom.kind == "LineString" and (rows[3].geom.parts[0][0][0].x, rows[3].source_crs) == (7.0, "EPSG:4326")
    assert shapefile.read(spark, path, "absent", "EPSG:4326").count() == 0
    with pytest.raises(Exception, match="CrsMismatch"):
        shapefile.read(spark, path, "layer", "EPSG:32636").collect()
    assert crs.CrsMismatch.__mro__[1] is ValueError


def test_geojson_round_trip(spark, tmp_path):
    shapes = [
        {"type": "Point", "coordinates": [35.5, 31.5]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]},
        {"type": "Polygon", "coordinates": [CW, CCW_HOLE]}, {"type": "MultiPolygon", "coordinates": [[CW], [CCW_HOLE]]}, {"type": "MultiPoint", "coordinates": [[0, 0], [1, 2]]},
    ]
    features = [{"type": "Feature", "properties": {"NAME": f"n{i}"}, "geometry": s} for i, s in enumerate(shapes)]
    features += [{"type": "Feature", "properties": {}, "geometry": None}, {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": []}}]
    file = tmp_path / "f.geojson"
    file.write_text("﻿" + json.dumps({"type": "FeatureCollection", "features": features}), encoding="utf-8")
    rows = geojson.read(spark, str(file))
    assert rows.count() == 6
    text = geojson.collection(rows.select(F.col("properties")["NAME"].alias("name"), F.lit(0).alias("zero"), F.lit("").alias("blank"), "geom"), {"count": 6}).first().value
    back = json.loads(text)
    assert back["count"] == 6 and "blank" not in back["features"][0]["properties"] and back["features"][0]["properties"]["zero"] == 0
    norm = lambda g: json.loads(json.dumps(g), parse_int=float)
    assert sorted(json.dumps(norm(f["geometry"])) for f in back["features"]) == sorted(json.dumps(norm(s)) for s in shapes)
    assert geojson.read(spark, str(tmp_path / "none.geojson")).count() == 0
    assert [r.properties["NAME"] for r in geojson.named(spark, str(file), "NAME", "n3").collect()] == ["n3"]
    geojson.write(rows.where("false"), str(tmp_path / "out"), {"definition": "empty"})
    assert json.loads(spark.read.text(str(tmp_path / "out/header")).first().value)["definition"] == "empty"
    assert spark.read.text(str(tmp_path / "out/features")).count() == 0


def test_delimited_and_json(spark, tmp_path):
    (tmp_path / "v.csv").write_text("﻿village;date\nA;01/02/2025\nB;\n", encoding="utf-8")
    rows = tables.csv(spark, str(tmp_path / "v.csv"), ";").collect()
    assert [r.asDict() for r in rows] == [{"village": "A", "date": "01/02/2025"}, {"village": "B", "date": None}]
    (tmp_path / "poha").mkdir()
    (tmp_path / "poha/beit-x.json").write_text(json.dumps([{"interview_id": "2", "name_en": "b"}, {"interview_id": "1"}, {"name_en": "no id"}]))
    (tmp_path / "poha/bad.json").write_text("not json")
    talks = tables.interviews(spark, str(tmp_path / "poha"), "https://example.org/%s")
    assert sorted((r.slug, r.url) for r in talks.collect()) == [("beit-x", "https://example.org/1"), ("beit-x", "https://example.org/2")]
    places = spark.createDataFrame([("beit-x",), ("other",), (None,)], "slug string")
    assert {r.slug: r.oral_histories and len(r.oral_histories) for r in tables.by_slug(places, talks, 1).collect()} == {"beit-x": 1, "other": None, None: None}
    (tmp_path / "o.json").write_text(json.dumps({"_note": {}, "k1": {"hebrew": "x"}}))
    assert [(r.key, r.hebrew) for r in tables.keyed_json(spark, str(tmp_path / "o.json"), "hebrew:string").collect()] == [("k1", "x")]
    registry = tables.registry(spark, [("s1", "CC0", True, "a", None), ("s2", "?", False, "", None)])
    assert tables.source(registry, "s1").licence == "CC0"
    with pytest.raises(KeyError):
        tables.source(registry, "zz")
    cited = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source_id string")
    assert [r.source_id for r in provenance.enabled_only(cited, registry).collect()] == ["s1"]
    assert provenance.unregistered(cited, registry).count() == 2
    assert tables.optional(spark, str(tmp_path / "nothing"), "a int").count() == 0


PAGE = '<ul><li><a class="list-item x" href="/en/12.html"><span class="date">07، Aug 2026</span> <b>Title</b> one</a></li><a class="list-item" href="/en/13.html" title="By attribute"></a><a class="list-item" href="/en/about.html">No</a><a class="list-item" href="/en/14.html"> </a><a class="other" href="/en/15.html">x</a></ul>'


def test_listing_and_article(spark):
    assert html.listed(PAGE, "list-item") == [{"url": "/en/12.html", "title": "Title one", "date_raw": "07، Aug 2026"}, {"url": "/en/13.html", "title": "By attribute", "date_raw": ""}]
    assert html.listed(None, "list-item") == [] and html.visible(None) == ""
    assert html.visible("<nav>n</nav><p>out</p><article><script>x</script><h1>A</h1> b &amp; c</article><footer>f</footer>") == "A b & c"
    rows = [("s", 1, PAGE), ("s", 2, PAGE.replace("12", "22")), ("s", 4, PAGE.replace("12", "42")), ("t", 1, PAGE)]
    got = {(r.section, r.url): r.page for r in html.crawl(spark.createDataFrame(rows, "section string, page int, html string")).collect()}
    assert got == {("s", "/en/12.html"): 1, ("s", "/en/13.html"): 1, ("s", "/en/22.html"): 2, ("t", "/en/12.html"): 1, ("t", "/en/13.html"): 1}


def test_layers_are_written_with_their_empty_members(spark, tmp_path):
    vocabulary = spark.createDataFrame([("a", "built"), ("b", "fence")], "extent_type string, definition string")
    features = spark.createDataFrame([(1, "a")], "id int, extent_type string")
    sinks.write_extents(features, vocabulary, str(tmp_path / "e"))
    assert {r.extent_type: r.n for r in spark.read.parquet(str(tmp_path / "e/layers")).collect()} == {"a": 1, "b": 0}
    sinks.write_split(spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ok boolean"), "ok", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/withheld")).count() == 2
    one, two = (sinks.build_id(spark, str(tmp_path / "e/layers")).first().build_id for _ in range(2))
    assert one == two and len(one) == 12


def test_streaming_deduplication(spark, tmp_path):
    rows = [("s", "u1", datetime(2024, 1, 1)), ("s", "u1", datetime(2024, 1, 1, 1)), ("s", "u2", datetime(2024, 1, 1, 2))]
    schema = "section string, url string, fetched timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = crawl.fresh_entries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.table("fresh").collect()) == ["u1", "u2"]
    assert G.RING.startswith("array")
