"""The build end to end over small fixtures, with its invariants."""

import json
from datetime import date

from pyspark.sql import functions as F

from terrane.config import RESOURCE_KEYWORDS
from terrane.functions import geometry as G
from terrane.operators import explainers, provenance
from terrane.plans import build
from tests.test_operators import LOCALITY, locality, polygons

EVIDENCE = "array<struct<source_id:string,title:string,url:string,document_date:date,retrieved:date,note:string>>"


def test_build_all(spark, tmp_path):
    ev = [("src", "title", None, None, None, None)]
    current = spark.createDataFrame([locality("c1", "Beit Ata Town", 0.2, 0.2, evidence=ev), locality("c2", "Huwara", 0.8, 0.8, ord=1, evidence=ev)], LOCALITY)
    historic = spark.createDataFrame([locality("pom-1", "Bayt Ata Town", 0.2, 0.2001, arabic="x", evidence=ev), locality("pom-2", "Lone Place", 0.5, 0.5, evidence=ev), locality("pom-3", "Other Name", 0.5, 0.5, evidence=ev)], LOCALITY)
    entities = polygons(spark, [("e1", 0, "Ariel", (0.1, 0.1, 0.3, 0.3)), ("e2", 1, "Unidentified settlement (7)", (0.6, 0.6, 0.7, 0.7))])
    entities = entities.withColumnRenamed("fid", "entity_id").withColumn("type", F.lit("settlement")).withColumn("extent_type", F.lit("built"))
    layers = {"zone": polygons(spark, [("z", 0, "z", (0, 0, 1, 1))]), "built": entities.withColumn("fid", F.col("entity_id")).withColumn("dated", F.lit("1990-01-01").cast("date")), "fence": polygons(spark, [("f", 0, "f", (0.2, 0.2, 0.4, 0.4))]).withColumn("dated", F.lit(None).cast("date"))}
    definitions = spark.createDataFrame([("built", "d"), ("fence", "d")], "extent_type string, definition string")
    base = build.build_base(current, historic, entities, layers, "zone", definitions, years=[1980], cell_m=4000.0)
    records = spark.createDataFrame([("i1", "In Beit Ata Town", None, "field_story"), ("i2", "Elsewhere", "", "field_story"), ("i3", "Huwara", "", "periodic")], "incident_id string, title string, body string, record_type string")
    tables = build.build_all(base, records)
    stats = {r.name: r.rows for r in build.write(tables, str(tmp_path), date(2024, 1, 1)).collect()}
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    assert {r.locality_id for r in read("localities").collect()} == {"c1", "c2"} and stats["withheld"] == 2 and stats["pairs"] == 1
    assert stats["incidents"] + stats["incidents_unplaced"] == 3 and [r.matched_locality_id for r in read("incidents").collect()] == ["c1"]
    assert {r.invariant for r in read("invariants").where("violations > 0").collect()} == set()
    assert {r.extent_type: r.n for r in read("layers").collect()} == {"built": 2, "fence": 0}
    assert [r.id for r in read("search_index").orderBy("part", "ord").collect()] == ["c1", "c2", "e1"]
    line = {(r.year, r.subset_key): r.km2 for r in read("timeline").collect()}
    assert line[1980, "built"] == 0 < line[None, "built"] and line[1980, "fence"] == 0 < line[None, "fence"]
    total = build.land_total(read("coverage"), ["fence", "built", "fence"]).collect()
    assert len(total) == 1 and total[0].subset_key == "built+fence"
    assert build.measures(read("features")).first().n == 2


def test_publish_sidecars_and_metadata(spark, tmp_path):
    ev = lambda s: [(s, "t", None, date(2020, 1, 1), date(2024, 1, 1), None)]
    places = spark.createDataFrame([locality("c1", "Beit Ata Town", 0.2, 0.2, arabic="ar", evidence=ev("s1")), locality("c2", "Huwara", 0.8, 0.8, ord=1, evidence=ev("s1"))], LOCALITY)
    index = spark.createDataFrame([("c2", 1, 0, None, None), ("c1", 0, 0, "ar", None), ("e1", 0, 1, None, "he")], "id string, ord int, part int, arabic string, hebrew string")
    withheld = places.where("false").select("locality_id", "name", "x", "y")
    incidents = spark.createDataFrame([("i1", "a", "field_story"), ("i2", "b", "periodic_report")], "incident_id string, title string, record_type string")
    hoisted, table = provenance.hoist(places)
    tables = {"localities": places, "search_index": index, "withheld": withheld, "hoisted": hoisted, "evidence": table, "incidents": incidents.limit(1), "incidents_unplaced": incidents.where("incident_id = 'i2'")}
    interviews = spark.createDataFrame([("c1", 2, "second"), ("c1", 1, "first"), ("zz", 1, "of no place")], "locality_id string, ord int, title string")
    claim = f"struct<text:string,evidence:{EVIDENCE}>"
    prose = spark.createDataFrame([("x1", "T", [("Water is metered.", ev("s2"))], ["Water is metered. Or not", "Unknown. Really"]), ("x2", "U", [("Bare", [])], [])], f"id string, title string, claims array<{claim}>, unverified array<string>")
    definitions = spark.createDataFrame([("built", "d")], "extent_type string, definition string")
    one = build.publish(tables, definitions, str(tmp_path / "a"), date(2024, 1, 1), interviews, prose)
    assert one == build.publish(tables, definitions, str(tmp_path / "b"), date(2025, 1, 1), interviews, prose) and len(one) == 12
    lines = lambda n, part="records": [json.loads(r.value) for r in spark.read.text(str(tmp_path / f"a/{n}/{part}")).collect()]
    assert [r["id"] for r in lines("sidecars/search_index")] == ["c1", "c2", "e1"] and lines("sidecars/search_index", "header")[0] == {"entries": 3, "arabic": 1, "hebrew": 1, "count": 3}
    assert lines("sidecars/oral_histories") == [{"locality_id": "c1", "interviews": [{"title": "first"}, {"title": "second"}]}]
    assert lines("sidecars/documents") == [{"title": "b"}] and lines("sidecars/locality_conflicts", "header")[0]["count"] == 0
    (meta,) = lines("meta", "header")
    assert meta["build_id"] == one and meta["stats"]["localities"] == 2 and meta["extent_definitions"] == {"built": "d"} and meta["stages"][6] == {"id": 7, "label": "Populated"}
    cited = {r["evidence_id"] for r in lines("meta")}
    claims = [c for r in lines("sidecars/explainers") for c in r["claims"]]
    assert len(cited) == 2 == meta["count"] and {e for c in claims for e in c["evidence_ref"]} < cited and all("evidence" not in c for c in claims)
    told, _ = explainers.published(prose)
    known = spark.createDataFrame([(i,) for i in cited], "evidence_id string")
    assert explainers.dangling(told, known).count() == 0 and [r.claim_id for r in explainers.uncited(told).collect()] == ["x2:0"]
    assert [r.question for r in explainers.asserted_and_disclaimed(told).collect()] == ["Water is metered. Or not"]
    assert explainers.without_claims(told).count() == 0


def test_destruction_and_municipal(spark):
    places = spark.createDataFrame([locality("l1", "Beita Town", 1.0, 1.0), locality("l2", "Huwara", 2.0, 2.0), locality("l3", "Huwara", 3.0, 3.0)], LOCALITY)
    rows = [("Beita Town", "01/02/2025", "attack", "water tank"), ("Beita Town", "31/02/2025", "attack", "olive tree, car"), ("Beita Town", "05/01/2025", "arrest", ""), ("Huwara", "01/01/2025", "x", "y"), ("Nowhere", "", "x", "y")]
    out = build.destruction(spark.createDataFrame(rows, "village string, date string, violation_type string, property_damage_type string"), places, RESOURCE_KEYWORDS)
    (r,) = out["placed"].collect()
    assert (r.locality_id, r.record_count, r.uncategorised, r.first_recorded, r.last_recorded) == ("l1", 3, 1, date(2025, 1, 5), date(2025, 2, 1))
    assert [(h.value, h.n) for h in r.violation_counts] == [("attack", 2), ("arrest", 1)]
    assert {h.value: h.n for h in r.resource_counts} == {"water": 1, "agriculture": 1, "property": 1}
    assert {w.village: w.records for w in out["withheld"].collect()} == {"Huwara": 1, "Nowhere": 1}
    areas = polygons(spark, [("A", 0, "a", (0, 0, 2, 2)), ("B", 1, "b", (2.5, 2.5, 4, 4)), ("C", 2, "c", (9, 9, 10, 10))]).drop("name")
    points = places.select("name", "x", "y").unionByName(places.select(F.lit("Other").alias("name"), F.lit(3.5).alias("x"), F.lit(3.5).alias("y")).limit(1))
    assert {m.fid: m.status for m in build.municipal(areas, points).collect()} == {"A": "named", "B": "ambiguous", "C": "unnamed"}
    assert G.POINT.startswith("struct")


def test_records_of_one_place_and_position_are_merged(spark):
    pop = lambda y, v: (y, v, None, None, "s")
    cite = lambda s: [(s, "t", None, None, None, None)]
    current = [
        locality("c1", "Beit Nur", 1.0, 1.0, ord=0, evidence=cite("s1"), population=[pop(2017, 5)], refs={"a": "1", "b": "1"}),
        locality("c2", "Bayt Nur", 1.0, 1.0, ord=1, arabic="ar2", evidence=cite("s2"), population=[pop(2007, 3), pop(2017, 9)], refs={"a": "2", "c": "2"}, slug="two", depopulated_1948=True),
        locality("c3", "Beit Nur", 1.0, 1.0, ord=2, arabic="ar3", evidence=cite("s3"), refs={"c": "3", "d": "3"}, slug=""),
        locality("c4", "Elsewhere", 5.0, 5.0, ord=3, evidence=cite("s4")),
    ]
    historic = [
        locality("pom-1", "Bayt Nur", 1.0, 1.001, ord=0, evidence=cite("h1")), locality("pom-2", "Dayr Zeit", 3.0, 3.0, ord=2, evidence=cite("h2")), locality("pom-3", "Deir Zeit", 3.0, 3.0, ord=1, evidence=cite("h3")),
        locality("pom-4", "Deir Zeit", 8.0, 8.0, ord=4, evidence=cite("h4")), locality("pom-5", "Olives", 8.0, 8.0, ord=5, evidence=cite("h5")),
    ]
    out = build.reconcile(spark.createDataFrame(current, LOCALITY), spark.createDataFrame(historic, LOCALITY))
    rows = {r.locality_id: r for r in out["localities"].collect()}
    assert sorted(rows) == ["c1", "c4", "pom-3"]
    r = rows["c1"]  # completed by pom-1 first, then by c2 and c3
    assert [e.source_id for e in r.evidence] == ["s1", "h1", "s2", "s3"]
    assert [(p.year, p.value) for p in r.population] == [(2007, 3), (2017, 5)]
    assert r.arabic == "ar2" and r.slug == "two" and r.refs == {"a": "1", "b": "1", "c": "2", "d": "3"}
    assert r.depopulated_1948 is False and r.transliterations == ["Bayt Nur", "Bayt Nur"] and r.historic_point is None
    assert [e.source_id for e in rows["pom-3"].evidence] == ["h3", "h2"]
    (s,) = out["stats"].collect()
    assert (s.current_records, s.historic_records, s.merged_pairs, s.output_localities) == (4, 5, 1, 3)
    assert (s.withheld_coordinate_conflicts, s.merged_on_shared_coordinates) == (2, 2)
    assert {(c.survivor_id, c.locality_id) for c in out["coincident"].collect()} == {("c1", "c2"), ("c1", "c3"), ("pom-3", "pom-2")}
    # every record's evidence is somewhere, or the record is withheld
    assert {e.source_id for r in rows.values() for e in r.evidence} == {"s1", "s2", "s3", "s4", "h1", "h2", "h3"}
    assert {w.locality_id for w in out["withheld"].collect()} == {"pom-4", "pom-5"}


def test_pairs_and_judgements_are_made_once(spark):
    none = spark.createDataFrame([], LOCALITY)
    plan = build.reconcile(none, none)["localities"]._jdf.queryExecution().analyzed().toString()
    assert "_hk" not in plan and "Window" not in plan
