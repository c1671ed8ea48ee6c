"""Operators on small fixtures: policies, conservation and edge cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import aggregates, coverage, gazetteer, provenance, quality, resolve, search, spatial

LOCALITY = (
    "locality_id string, ord long, name string, arabic string, hebrew string, transliterations array<string>, x double, y double, district string, depopulated_1948 boolean,"
    " depopulated_date string, slug string, population array<struct<year:int,value:bigint,grp:string,note:string,source_id:string>>, refs map<string,string>,"
    " evidence array<struct<source_id:string,title:string,url:string,document_date:date,retrieved:date,note:string>>"
)


def locality(i, name, x, y, **k):
    base = dict(locality_id=i, ord=k.pop("ord", 0), name=name, arabic=None, hebrew=None, transliterations=[], x=x, y=y, district=None, depopulated_1948=False, depopulated_date=None, slug=None, population=[], refs={}, evidence=[])
    return tuple((base | k).values())


def polygons(spark, boxes):
    df = spark.createDataFrame([(f, o, n, *map(float, b)) for f, o, n, b in boxes], "fid string, ord int, name string, a double, b double, c double, d double")
    ring = G.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return df.select("fid", "ord", "name", G.geometry("Polygon", F.array(F.array(ring))).alias("geom"))


@pytest.fixture(scope="module")
def areas(spark):
    return polygons(spark, [("A", 0, "north", (0, 0, 2, 2)), ("B", 1, "south", (1, 1, 3, 3)), ("C", 2, "empty", (8, 8, 9, 9))])


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(1, 0.5, 0.5, "north"), (2, 1.5, 1.5, "x"), (3, 2.5, 2.5, " "), (4, 7.0, 7.0, None), (5, float("nan"), 0.0, "a"), (6, None, None, "b")], "pid int, x double, y double, label string")


def test_containment_policies(points, areas):
    first = {r.pid: r.fid for r in spatial.first_match(points, areas, "pid", "fid", "ord", F.lit("none")).collect()}
    assert first == {1: "A", 2: "A", 3: "B", 4: "none", 5: "none", 6: "none"}
    names = {r.fid: (r.n_names, r.given_name) for r in spatial.exactly_one(areas, points, "fid", "pid").collect()}
    assert names == {"A": (2, None), "B": (2, None), "C": (0, None)}
    counted = {r.fid: (r.n_points, r.labelled, r.agreeing) for r in spatial.counts(points, areas, "pid", "fid", "ord", "label", "name").collect()}
    assert counted == {"A": (2, 2, 1), "B": (1, 0, 0), "C": (0, 0, 0)}
    assert sorted(r.pid for r in spatial.outside(points, areas, "pid").collect()) == [4, 5, 6]
    assert {r.pid: r.fid for r in spatial.topmost(points, areas, "pid", "fid", "ord").collect()} == {1: "A", 2: "A", 3: "B"}


def test_anchors(spark, areas):
    claims = spark.createDataFrame([("A", 1.0, 1.0), ("C", 1.0, 1.0), ("Z", 1.0, 1.0)], "fid string, x double, y double")
    assert {r.fid: r.outcome for r in spatial.verify_anchors(claims, areas, "fid").collect()} == {"A": "applied", "C": "refused", "Z": "unknown"}
    one = spark.createDataFrame([("a1", 0.5, 0.5)], "anchor string, x double, y double")
    assert [r.fid for r in spatial.holders_or_raise(one, areas, "anchor", "fid").collect()] == ["A"]
    two = spark.createDataFrame([("a1", 1.5, 1.5)], "anchor string, x double, y double")
    with pytest.raises(Exception, match="lies in 2 polygons"):
        spatial.holders_or_raise(two, areas, "anchor", "fid").collect()


def test_raster_agrees_with_cell_centres(spark):
    outer = [(0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (2.5, 1.0), (0.0, 4.0), (0.0, 0.0)]  # concave
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)]
    other = [(3.0, 0.2), (6.0, 0.2), (4.5, 3.1), (3.0, 0.2)]
    rings = lambda p: F.array(F.array(*[F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in r]) for r in p]))
    one = spark.range(1).select(F.lit("a").alias("fid"), G.geometry("Polygon", rings([outer, hole])).alias("geom"))
    two = spark.range(1).select(F.lit("b").alias("fid"), G.geometry("Polygon", rings([other])).alias("geom"))
    grid = coverage.Grid(0.0, 0.0, 6.0, 4.0, cell_m=20_000.0)

    def inside(r, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    want = {}
    for row in range(grid.rows):
        for col in range(grid.columns):
            x, y = (col + 0.5) * grid.lon_step, (row + 0.5) * grid.lat_step
            mask = (inside(outer, x, y) != inside(hole, x, y)) + 2 * inside(other, x, y)
            if mask:
                want[row, mask] = want.get((row, mask), 0) + 1
    got = {(r.row, r.mask): r.n for r in coverage.masks([one, two], grid).collect()}
    assert got == want and len({m for _, m in got}) == 3


def test_union_of_subsets_and_clip(spark):
    ext = polygons(spark, [("E", 0, "e", (0, 0, 1, 1))])
    a, b = polygons(spark, [("a", 0, "a", (0, 0, 0.5, 1))]), polygons(spark, [("b", 0, "b", (0.25, 0, 1.25, 1))])
    layers = {"ext": ext, "a": a, "b": b, "none": polygons(spark, [("n", 0, "n", (3, 3, 4, 4))])}
    rows = {r.subset_key: r for r in coverage.coverage(layers, "ext", 2000.0).collect()}
    assert len(rows) == 7 and abs(rows["a"].pct - 50) < 2 and abs(rows["a+b"].pct - 100) < 2 and rows["none"].km2 == 0
    assert quality.not_a_union(coverage.coverage(layers, "ext", 2000.0)).count() == 0
    assert max(rows["a"].km2, rows["b"].km2) <= rows["a+b"].km2 <= rows["a"].km2 + rows["b"].km2


def test_merge_pairs_by_distance_and_name(spark):
    step = 1 / 111_320
    current = spark.createDataFrame([locality("c1", "Beit Mirsim", 35.0, 31.0), locality("c2", "Other Place", 35.2, 31.2), locality("c3", "Deir Far", 35.5, 31.5)], LOCALITY)
    historic = spark.createDataFrame(
        [
            locality("pom-1", "Bayt Mirsim", 35.0, 31.0 + 599 * step), locality("pom-2", "Bayt Mirsim", 35.0, 31.0 + 601 * step), locality("pom-3", "Dayr Far", 35.5, 31.5 + 2499 * step),
            locality("pom-4", "Dayr Far", 35.5, 31.5 + 2501 * step), locality("pom-5", "Quite Unlike", 35.2, 31.2), locality("pom-6", "Other Place", 35.2, 31.2, depopulated_1948=True), locality("pom-7", "", 35.2, 31.2),
        ], LOCALITY,
    )
    pairs = resolve.matched_pairs(current, historic)
    assert {(r.historic_id, r.current_id, r.wide) for r in pairs.collect()} == {("pom-1", "c1", False), ("pom-2", "c1", True), ("pom-3", "c3", True)}
    merged = resolve.merge_localities(current, historic, pairs)
    assert {r.locality_id for r in merged.collect()} == {"c1", "c2", "c3", "pom-4", "pom-5", "pom-6", "pom-7"}


def test_survivor_policy(spark):
    pop = lambda y, v, g=None: (y, v, g, None, "s")
    current = spark.createDataFrame([locality("c", "Beit X", 1.0, 1.0, district="d", population=[pop(2017, 5)], refs={"a": "new"}, evidence=[("s1", "t", None, None, None, None)])], LOCALITY)
    historic = spark.createDataFrame([locality("h", "Bayt X", 1.0, 1.001, ord=1, arabic="ar", district="z", slug="sl", depopulated_1948=False, population=[pop(1945, 9), pop(2017, 7)], refs={"a": "old", "b": "kept"}, evidence=[("s2", "t", None, None, None, None)])], LOCALITY)
    pairs = spark.createDataFrame([("h", "c")], "historic_id string, current_id string")
    (r,) = resolve.merge_localities(current, historic, pairs).collect()
    assert (r.arabic, r.district, r.slug, r.refs) == ("ar", "d", "sl", {"a": "new", "b": "kept"})
    assert [(p.year, p.value) for p in r.population] == [(1945, 9), (2017, 5)]
    assert [e.source_id for e in r.evidence] == ["s1", "s2"] and r.historic_point.y == 1.001 and r.transliterations == ["Bayt X"]


def test_conflicts_are_withheld_with_reasons(spark):
    rows = [
        locality("own-1", "Beit A", 1.0, 1.0), locality("pom-1", "Bayt A", 1.0, 1.0), locality("own-2", "Olives", 2.0, 2.0), locality("pom-2", "Harbour", 2.0, 2.0),
        locality("pom-3", "Olives", 3.0, 3.0), locality("pom-4", "Harbour", 3.0, 3.0), locality("pom-5", "Alone", 4.0, 4.0),
    ]
    got = {r.locality_id: (r.decision, r.survivor_id) for r in resolve.coordinate_conflicts(spark.createDataFrame(rows, LOCALITY)).collect()}
    assert got == {"own-1": ("keep", "own-1"), "pom-1": ("merge", "own-1"), "own-2": ("keep", "own-2"), "pom-2": ("withhold", "own-2"), "pom-3": ("withhold", None), "pom-4": ("withhold", None), "pom-5": ("keep", "pom-5")}


def test_unique_ids(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("x", 2), ("x-2", 3), ("y", 4)], "slug string, ord int")
    ids = [r.unique_id for r in resolve.unique_ids(df, "slug", "ord").orderBy("ord").collect()]
    assert ids == ["x", "x-2", "x-2-2", "x-2-2-2", "y"]


def test_incident_tiers(spark):
    places = spark.createDataFrame([locality("l1", "Beita Town", 1.0, 1.0), locality("l2", "Huwara", 1.0, 2.0), locality("l3", "Huwara", 1.0, 3.0), locality("l4", "Gaza", 1.0, 4.0)], LOCALITY)
    records = spark.createDataFrame(
        [("i1", "Attack in Beita Town", "Huwara", "field_story"), ("i2", "Attack", "seen near Beita Town today", "field_story"), ("i3", "Huwara closed", "", "field_story"), ("i4", "Gaza", None, "field_story"), ("i5", "Beita Town", "x", "periodic")],
        "incident_id string, title string, body string, record_type string",
    )
    got = {r.incident_id: (r.confidence, r.matched_locality_id, r.matched_from) for r in gazetteer.incidents(records, gazetteer.index(places), places).collect()}
    assert got == {"i1": ("matched", "l1", "title"), "i2": ("matched", "l1", "body"), "i3": ("ambiguous", None, "title"), "i4": ("unresolved", None, None), "i5": ("unresolved", None, None)}
    exact = gazetteer.exact(spark.createDataFrame([("a", "beita town"), ("b", "Huwara"), ("c", "Gaza")], "k string, name string"), gazetteer.index(places, guarded=False), "k", "name")
    assert {r.k: (r.n_candidates, r.locality_id) for r in exact.collect()} == {"a": (1, "l1"), "b": (2, None), "c": (1, "l4")}


def test_citations(spark):
    ev = "struct<source_id:string,title:string,url:string,document_date:date,retrieved:date,note:string>"
    a, b = ("s", "t", None, date(2020, 1, 1), None, None), ("s", "t", "", date(2020, 1, 1), None, "")
    c = ("s2", "t", None, None, None, None)
    df = spark.createDataFrame([(1, [a, b, c], [(2, [c])]), (2, [], [])], f"id int, evidence array<{ev}>, stages array<struct<stage:int,evidence:array<{ev}>>>")
    rows, table = provenance.hoist(df, nested={"stages": "evidence"})
    got = {r.id: r for r in rows.collect()}
    assert table.count() == 2 and len(got[1].evidence_ref) == 2 and got[1].stages[0].evidence_ref == got[1].evidence_ref[1:]
    assert provenance.dangling(rows, table, "id").count() == 0
    assert provenance.dangling(rows, table.where("source_id = 's'"), "id").count() == 1
    assert quality.uncited(rows, "id").count() == 1
    assert [r.source_id for r in provenance.resolve(rows, table, "id").orderBy("place").collect()] == ["s", "s2"]


def test_search_ranks_word_starts_first(spark):
    places = spark.createDataFrame([("p1", 0, "Old Beit Ur", 1.0, 1.0), ("p2", 1, "Beit Ur", 1.0, 2.0), ("p3", 2, "Abeit", 1.0, 3.0), ("p4", 3, "Xbeit beit", 1.0, 3.0)], "id string, ord int, name string, x double, y double")
    settlements = spark.createDataFrame([("e1", 0, "Beit El", 5.0, 5.0), ("e2", 1, "Beit El", 5.001, 5.0), ("e3", 2, "Unidentified settlement (9)", 6.0, 6.0), ("e4", 3, "Beit El", 7.0, 7.0)], "id string, ord int, name string, x double, y double")
    index = search.build(places, settlements)
    assert [r.id for r in search.search(index, "beit").collect()] == ["p1", "p2", "e1", "e4", "p3", "p4"]
    assert [r.id for r in search.search(index, "beit", 2).collect()] == ["p1", "p2"]
    assert search.search(index, "b").count() == 0


def test_tallies(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "labels array<string>")
    assert {r.label: r.n for r in aggregates.label_tally(df, "labels").collect()} == {"a": 2, "b": 1, "uncategorised": 1}
    rows = spark.createDataFrame([("r", date(2024, 1, 1), date(2024, 1, 2), 1, 2), ("s", date(2024, 1, 1), None, 1, None)], "k string, d1 date, d2 date, a1 int, a2 int")
    long = aggregates.unpivot_rounds(rows, ["k"], {"1": ("a1", "d1"), "2": ("a2", "d2")})
    got = {r.round: (r.n, r.dated, r.mixed) for r in aggregates.round_summary(long).collect()}
    assert got == {"1": (2, date(2024, 1, 1), False), "2": (1, date(2024, 1, 2), False)}


def test_invariant_report(spark, areas, points):
    checks = {"rings": quality.open_rings(areas), "range": quality.out_of_range(areas, 0, 0, 5, 5), "outside": quality.points_outside(points, areas, "pid"), "blank": quality.blank_strings(points, ["label"])}
    assert {r.invariant: r.violations for r in quality.report(checks).collect()} == {"rings": 0, "range": 1, "outside": 3, "blank": 1}


@pytest.mark.parametrize("most", [100_000, 0])
def test_ngrams_are_never_broadcast(spark, tmp_path, monkeypatch, most):
    rows = [(1, "of the old town"), (2, "the old"), (3, "none here"), (4, "old town of old town")]
    spark.createDataFrame(rows, "id int, t string").write.parquet(f"{tmp_path}/texts")
    known = spark.createDataFrame([("the old",), ("old town",), ("old",), ("old",)], "norm string")
    monkeypatch.setattr(gazetteer, "BROADCAST_PHRASES", most, raising=False)
    found = gazetteer.longest_phrases(spark.read.parquet(f"{tmp_path}/texts"), known, "id", "t", already_normal=True)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 0)
    assert sorted(map(tuple, found.collect())) == [(1, "old town"), (2, "the old"), (4, "old town")]


def test_names_propagate_between_positions_not_records(spark, monkeypatch):
    names = ("olive", "harbour")
    targets = [(f"t{i}", names[i % 2], 35.0, (i % 3) * 0.015, "own" if i % 10 == 0 else None) for i in range(120)] + [("t1", "olive", 36.0, 0.0, None), ("none", "olive", None, 0.0, None)]
    sources = [((i * 7) % 90, names[i % 2], 35.0, 0.01 + (i % 2) * 0.02, f"h{i}" if i % 4 else None) for i in range(90)] + [(None, "olive", 35.0, 0.0, "unordered"), (-1, "olive", 36.0, 0.0, "far")]
    t = spark.createDataFrame(targets, "locality_id string, name string, x double, y double, hebrew string")
    s = spark.createDataFrame(sources, "ord long, name string, x double, y double, hebrew string")
    met, own_cell, around = [], G.own_cell, G.around
    monkeypatch.setattr(G, "own_cell", lambda rows, *a: met.append(rows.count()) or own_cell(rows, *a))
    monkeypatch.setattr(G, "around", lambda rows, *a: met.append(rows.count()) or around(rows, *a))
    got = sorted((r.locality_id, r.x or 0.0, r.hebrew or "") for r in resolve.propagate_names(t, s).collect())

    def reach(i):
        for j, n, x, y, own in targets:
            if j == i and own is None and x is not None:
                yield from ((o, v) for o, m, a, b, v in sources if m == n and v and o is not None and abs(a - x) < 0.02 and abs(b - y) * 111320 <= 2500)

    assert got == sorted((i, x or 0.0, own or min(reach(i), default=(0, ""))[1]) for i, n, x, y, own in targets)
    assert max(met) <= 8
