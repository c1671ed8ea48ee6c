"""Loaders from records to layers, and flat client rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import flat, resolve, spatial
from terrane.sources import layers

CITE = {"source_id": "src", "title": "A file", "url": "http://x", "document_date": "2019-07-24", "retrieved": "2026-01-02", "note": "as found"}
RECORDS = f"ord int, attributes map<string,string>, geom {G.GEOMETRY}, source_crs string"


def square(x, y, side=1.0):
    x, y = float(x), float(y)
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return ("Polygon", [[ring]])


def point(x, y):
    return ("Point", [[[(float(x), float(y))]]])


def records(spark, rows):
    return spark.createDataFrame([(i, a, g, "EPSG:4326") for i, (a, g) in enumerate(rows)], RECORDS)


def test_mislabelled_areas_are_told_apart_by_anchors(spark):
    rows = records(spark, [({"CLASS": " A "}, square(0, 0)), ({"CLASS": "A"}, square(5, 5)), ({"CLASS": "C"}, square(9, 9))])
    anchors = spark.createDataFrame([("one", 5.2, 5.2), ("two", 5.7, 5.7)], "anchor string, x double, y double")
    got = {r.ord: (r.oslo_class, r.class_corrected is not None, len(r.evidence)) for r in layers.oslo_areas(rows, anchors, CITE).collect()}
    assert got == {0: ("B", True, 1), 1: ("A", False, 1), 2: ("C", False, 1)}
    split = spark.createDataFrame([("one", 5.2, 5.2), ("two", 0.5, 0.5)], "anchor string, x double, y double")
    with pytest.raises(Exception, match="different polygons"):
        layers.oslo_areas(rows, split, CITE).collect()
    single = rows.where("ord <> 0")  # one polygon of the label: nothing to tell apart, whatever the anchors
    assert {r.oslo_class for r in layers.oslo_areas(single, split, CITE).collect()} == {"A", "C"}


def test_settlements_are_grouped_named_and_identified(spark):
    rows = records(
        spark,
        [
            ({"GIS_ID": "7.0", "Name": ""}, square(0, 0)), ({"GIS_ID": "7.0", "Name": "Alon"}, square(3, 0)), ({"GIS_ID": "0", "Name": "Alon"}, square(6, 0)),
            ({"Name": " "}, square(9, 0)), ({"GIS_ID": "8", "Name": None}, square(12, 0)), ({"GIS_ID": "9", "Name": None}, square(15, 0)),
        ],
    )
    known = spark.createDataFrame(
        [("gid-8", "Found", 12.5, 0.5, "t", "u", date(2025, 1, 1), "m"), ("gid-9", "Lost", 99.0, 0.5, "t", "u", date(2025, 1, 1), "m"), ("gid-7", "Never", 0.5, 0.5, "t", "u", None, "m")],
        "key string, given string, x double, y double, title string, url string, identified date, method string",
    )
    ej = spark.createDataFrame([(square(14, -1, 4.0),)], f"geom {G.GEOMETRY}")
    got = {r.key: r for r in layers.settlements(rows, CITE, date(2020, 1, 1), ej, known).collect()}
    assert {k: (r.entity_id, r.name, r.outcome, r.type) for k, r in got.items()} == {
        "gid-7": ("alon", "Alon", None, "settlement"), "name-alon": ("alon-2", "Alon", None, "settlement"), "orphan-3": ("orphan-3", "Unidentified settlement (orphan-3)", None, "settlement"),
        "gid-8": ("gid-8", "Found", "applied", "settlement"), "gid-9": ("gid-9", "Unidentified settlement (gid-9)", "refused", "ej_settlement"),
    }
    assert (got["gid-7"].geom.kind, len(got["gid-7"].geom.parts)) == ("MultiPolygon", 2) and got["gid-8"].geom.kind == "Polygon"
    assert [e.source_id for e in got["gid-8"].evidence] == ["src", "wikidata"] and got["gid-9"].evidence[0].note == layers.BLANK_NAME
    assert got["gid-7"].stage_history[0].valid_from == date(2020, 1, 1) and got["gid-7"].area_m2 > 0


def test_localities_leave_out_a_region_and_keep_notes(spark):
    oslo = records(spark, [({}, square(0, 0, 2.0)), ({}, square(1, 1, 2.0))]).select("ord", "geom", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("oslo_class"))
    rows = records(
        spark,
        [
            ({"Region": "Gaza Strip", "PCBS_NAME": "g"}, point(0.5, 0.5)), ({"Region": "West Bsnk", "PCBS_NAME": "Ein X", "PCODE": "12", "pop2017": "17230", "EJ": "1"}, point(1.5, 1.5)),
            ({"Region": None, "PCBS_NAME": "Beit Y", "pop2017": "with Ar Ram", "Oslo_Areas": "B"}, point(9.5, 9.5)), ({"pop2017": "NA"}, point(2.5, 2.5)),
        ],
    )
    got = {r.ord: r for r in layers.localities(rows, oslo, CITE).collect()}
    assert {k: (r.locality_id, r.oslo_area, r.in_east_jerusalem, [(p.value, p.note) for p in r.population]) for k, r in got.items()} == {
        1: ("12", "c0", True, [(17230, None)]), 2: ("beit-y", "B", False, [(None, "with Ar Ram")]), 3: ("unnamed-locality", "c1", False, []),
    }


def test_zones_facilities_and_neighbourhoods(spark):
    zones = records(spark, [({"FIRE_NAME": "903", "SIGN_DATE": "1972-03-01"}, square(35, 31, 0.1)), ({"FIRE_NAME": "309�'", "SIGN_DATE": None}, square(35, 31, 0.1))])
    got = [(r.name, r.signed_date, r.evidence[0].document_date) for r in layers.firing_zones(zones, CITE).orderBy("ord").collect()]
    assert got == [("Firing zone 903", date(1972, 3, 1), date(1972, 3, 1)), ("Firing zone (unnumbered)", None, None)]
    places = records(spark, [({"name": "A", "Type": "Sub Station"}, point(35, 31)), ({"name": "B", "Type": "Sub-Station"}, point(35, 31)), ({"name": " ", "Type": None}, point(-1.7976931348623157e308, 0.0)), ({"name": "C"}, None)])
    out = layers.facilities(places, CITE, "a society")
    assert [(r.facility_type, r.n) for r in out["by_type"].collect()] == [("Sub-Station", 2)]
    assert sorted(r.name for r in out["withheld"].collect()) == ["C", "Unnamed facility"] and out["plotted"].count() == 2
    rows, stats = layers.gaza_neighbourhoods(records(spark, [({"Neighbourh": "N", "Communithy": "c"}, square(0, 0)), ({"DISTRICT": "d"}, square(0, 0))]), CITE, "then")
    assert stats.first().asDict() == {"total": 2, "with_district": 1, "with_community": 1, "with_arabic": 0} and rows.count() == 2
    assert [r.named for r in layers.gaza_municipal(records(spark, [({"NAME": "m"}, square(0, 0)), ({}, square(0, 0))]), CITE, "then").orderBy("ord").collect()] == [True, False]
    assert layers.village_boundaries(records(spark, [({"VNAME": "--"}, square(0, 0))]), CITE).first().name == "Unnamed village"
    assert layers.barrier(records(spark, []), CITE).count() == 0


def test_outlines_by_type_and_unknown_types(spark):
    rows = records(spark, [({"NameEng": "A b", "Type": "Outpost"}, square(0, 0)), ({"NameEng": "A b", "Type": "farm"}, square(0, 0)), ({"Name": "שם"}, square(0, 0))])
    out = layers.boundaries(rows, CITE, date(2024, 1, 1))
    assert [(r.entity_id, r.type) for r in out.orderBy("ord").collect()][:2] == [("bts-a-b", "outpost"), ("bts-a-b-2", "settlement")]
    assert [(r.raw_type, r.n) for r in layers.unknown_terms(out.where("raw_type is not null"), "raw_type", layers.TYPE_MAP).collect()] == [("farm", 1)]


HISTORIC = "id district_1945 lat lng change_2016 end pop_1922 pop_1931 pop_1945 pal_1945 jsh_1945 pop_2016 url_pr id_zo name_en name_ar name_he slug subdistrict_1945 grp_1945 grp_2016".split()


def test_historic_localities_and_their_flat_rows(spark):
    def row(**given):
        return tuple(given.get(c) for c in HISTORIC)

    rows = [
        row(id="1", lat="31.5", lng="35.25", change_2016="Depopulated & built over", end="1948-05-01", pop_1922="1,200", pop_1945="2000", pal_1945="1,900", jsh_1945="100", url_pr="x", name_en="One"),
        row(id="2", lat="31.5", lng="35.25", change_2016="Depopulated", end="1967-06", pop_1945="10", pal_1945="50"),
        row(id="3", lat="", lng="35.25"), row(id="4", lat="30", lng="34", district_1945="Sinai "), row(id="5", lat="31", lng="35", pop_1945="0", pop_1931="n/a"),
    ]
    out = layers.historic(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in HISTORIC)), CITE)
    got = {r.locality_id: r for r in out.collect()}
    assert set(got) == {"pom-1", "pom-2", "pom-5"}
    assert [(p.year, p.value, p.grp) for p in got["pom-1"].population] == [(1922, 1200, None), (1945, 2000, None), (1945, 1900, "Palestinian"), (1945, 100, "Jewish")]
    assert got["pom-1"].mechanism == "depopulation_1948" and got["pom-1"].depopulated_1948 and list(got["pom-1"].refs) == ["palestine_remembered"]
    assert got["pom-2"].mechanism is None and not got["pom-2"].depopulated_1948
    assert [(p.value, p.grp) for p in got["pom-2"].population] == [(10, None)] and got["pom-2"].evidence[0].note == layers.CONTRADICTION and got["pom-1"].evidence[0].note == "as found"
    flat_rows = {r.locality_id: r for r in flat.locality_rows(out.withColumn("oral_histories", F.when(F.col("ord") == 1, F.array(F.lit(1))).otherwise(F.array()))).collect()}
    assert [(r.pop_1945_total, r.pop_1945_palestinian, r.oral_history_count) for _, r in sorted(flat_rows.items())] == [(2000, 1900, 1), (10, None, None), (None, None, None)]
    sized = flat.locality_rows(out)
    assert sorted(r[0] for r in sized.select(flat.symbol_size(sized)).collect()) == [0, 10, 1900]
    assert list(flat_rows["pom-1"].asDict()) == list(flat.LOCALITY)


def test_flat_rows_and_small_rules(spark):
    entities = spark.createDataFrame([("e", "settlement", "N", [(4, date(1990, 1, 1)), (5, date(1985, 1, 1))]), ("f", "outpost", "M", [])], "entity_id string, type string, name string, stage_history array<struct<stage:int,valid_from:date>>")
    assert flat.entity_rows(entities).columns == list(flat.ENTITY) and flat.first_year(entities).first()[0] == 1985
    assert flat.incident_rows(spark.createDataFrame([("i", "t")], "incident_id string, title string")).first().asDict()["title"] == "t"
    labels = spark.createDataFrame([("a", "ب"), ("a", " "), ("a", None)], "n string, ar string").select(flat.label(F.col("n"), F.col("ar")))
    assert [r[0] for r in labels.collect()] == ["a\nب", "a", "a"]
    series = spark.createDataFrame([("k", 1, 2.0), ("k", 2, 8.0), ("z", 1, 0.0)], "k string, y int, v double")
    assert sorted(((r.k, r.share) for r in flat.relative_to_last(series, "k", "y", "v").collect()), key=str) == [("k", 0.25), ("k", 1.0), ("z", None)]
    boxes = records(spark, [({}, square(1, 2)), ({}, square(5, 0))])
    assert tuple(flat.layer_box(boxes, (0, 0, 9, 9)).first()) == (1.0, 0.0, 6.0, 3.0) and tuple(flat.layer_box(boxes.where("false"), (0, 0, 9, 9)).first()) == (0.0, 0.0, 9.0, 9.0)
    assert boxes.select(flat.point_of(F.col("geom"))["x"]).first()[0] == 1.0
    pairs = spark.createDataFrame([([1, 2], ["a", "b"])], "n array<int>, s array<string>").select(flat.zipped(["n", "s"], F.col("n"), F.col("s")))
    assert [tuple(p) for p in pairs.first()[0]] == [(1, "a"), (2, "b")]


def test_unique_ids_in_source_order(spark):
    keys = ["a-2", "a", "a", None, "b", "b", "b-2", "a-2-2", "c"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "ord int, key string")
    used, want = set(), []
    for k in keys:
        while k is not None and k in used:
            k += "-2"
        used.add(k)
        want.append(k)
    assert [r.unique_id for r in resolve.unique_ids(rows, "key", "ord").orderBy("ord").collect()] == want
    hot = spark.range(3000).select(F.col("id").cast("int").alias("ord"), F.lit("unnamed").alias("key")).repartition(7)
    got = [r.unique_id for r in resolve.unique_ids(hot, "key", "ord").orderBy("ord").limit(4).collect()]
    assert got == ["unnamed", "unnamed-2", "unnamed-2-2", "unnamed-2-2-2"]
    with pytest.raises(Exception, match="lies in"):
        spatial.holders_or_raise(spark.createDataFrame([("n", 50.0, 50.0)], "anchor string, x double, y double"), records(spark, [({}, square(0, 0))]), "anchor", "ord").collect()


def test_overrides_add_their_evidence(spark):
    rows = spark.createDataFrame([("a", None, ["e1"]), ("b", "own", ["e2"])], "locality_id string, hebrew string, evidence array<string>")
    given = spark.createDataFrame([("a", "h", ["e3"]), ("b", "h", ["e4"])], "locality_id string, hebrew string, evidence array<string>")
    got = {r.locality_id: (r.hebrew, r.evidence, r.overridden) for r in resolve.apply_overrides(rows, given).collect()}
    assert got == {"a": ("h", ["e1", "e3"], True), "b": ("own", ["e2"], False)}
