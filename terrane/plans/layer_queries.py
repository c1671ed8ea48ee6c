"""Queries of the loaders and client rows, over records landed from the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from terrane.functions import crs
from terrane.functions import geometry as G
from terrane.operators import flat, search
from terrane.plans import build
from terrane.plans.derived import CUSTOMERS, INSIDE, NATIONS, customer_points, nation_polygons, part_rectangles, supplier_points
from terrane.plans.registry import query
from terrane.session import table
from terrane.sources import layers, tables

CITE = {"source_id": "src", "title": "a landed file", "url": None, "document_date": "2020-01-01", "retrieved": "2024-01-01", "note": None}


def _map(**fields):
    return F.create_map(*[v for k, c in fields.items() for v in (F.lit(k), c.cast("string"))])


def _point(x, y):
    return G.geometry("Point", F.array(F.array(F.array(G.point(x, y)))))


def _squares(spark, d):
    """Parts as records of a file of polygons."""
    boxes = part_rectangles(spark, d).select(F.col("fid").alias("p_partkey"), "geom")
    return table(spark, d, "part").join(boxes, "p_partkey").withColumns({"ord": F.col("p_partkey"), "source_crs": F.lit("EPSG:4326")})


@query("""WITH r AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 10 > 1 AND p_partkey % 300 <> 0 THEN p_partkey % 300 END AS gid,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ' || CAST(p_partkey % 300 AS VARCHAR) END AS own FROM part),
  n AS (SELECT *, coalesce(own, first_value(own IGNORE NULLS) OVER (PARTITION BY gid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS found FROM r),
  k AS (SELECT ord, CASE WHEN gid IS NULL THEN own ELSE found END AS name, CASE WHEN gid IS NOT NULL THEN 'gid-' || gid WHEN own IS NOT NULL THEN 'name-' || regexp_replace(lower(own), '[^a-z0-9]+', '-', 'g') ELSE 'orphan-' || ord END AS key FROM n)
SELECT key, coalesce(arg_min(name, ord) FILTER (WHERE name IS NOT NULL), 'Unidentified settlement (' || key || ')') AS name, count(*) AS n_parts, count(name) = 0 AS blank, CAST(4 AS INTEGER) AS stage FROM k GROUP BY key""")
def layer_settlements(spark, d):
    """Built-up polygons: parts of one id are one place with the first name that a part has."""
    k = F.col("p_partkey")
    gid = F.when(k % 10 == 0, "").when(k % 10 == 1, "0").otherwise((k % 300).cast("string"))
    records = _squares(spark, d).withColumn("attributes", _map(GIS_ID=gid, Name=F.when(k % 3 == 0, F.concat_ws(" ", "p_brand", (k % 300).cast("string"))).otherwise(" ")))
    out = layers.settlements(records.select("ord", "attributes", "geom", "source_crs"), CITE, date(2020, 1, 1))
    blank = F.coalesce(F.get("evidence", F.lit(0))["note"] == layers.BLANK_NAME, F.lit(False))
    return out.select("key", "name", F.size("geom.parts").cast("long").alias("n_parts"), blank.alias("blank"), F.get("stage_history", F.lit(0))["stage"].alias("stage"))


_KINDS = "CASE s_suppkey % 6 WHEN 0 THEN 'Outpost' WHEN 1 THEN ' settlement ' WHEN 2 THEN 'Industrial Area' WHEN 3 THEN 'ruin' WHEN 4 THEN 'camp' END"


def _outlines(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 6 == 0, "Outpost").when(k % 6 == 1, " settlement ").when(k % 6 == 2, "Industrial Area").when(k % 6 == 3, "ruin").when(k % 6 == 4, "camp")
    x, y = (k % 90) / 10.0, (k % 70) / 10.0
    box = G.geometry("Polygon", F.array(F.array(G.rectangle(x, y, x + 0.1, y + 0.1))))
    return table(spark, d, "supplier").select(k.alias("ord"), _map(NameEng=F.when(k % 4 != 0, F.col("s_name")), Name=F.when(k % 8 != 0, F.concat(F.lit("h "), "s_name")), Type=kind).alias("attributes"), box.alias("geom"))


@query(f"""SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 4 <> 0 THEN s_name WHEN s_suppkey % 8 <> 0 THEN 'h ' || s_name ELSE 'Unnamed' END AS name, CASE WHEN s_suppkey % 8 <> 0 THEN 'h ' || s_name END AS hebrew,
  CASE lower(trim({_KINDS})) WHEN 'outpost' THEN 'outpost' WHEN 'industrial area' THEN 'industrial_zone' ELSE 'settlement' END AS type, 'settlement_boundary' AS extent_type FROM supplier""")
def layer_boundaries(spark, d):
    return layers.boundaries(_outlines(spark, d), CITE, date(2020, 1, 1)).select("ord", "name", "hebrew", "type", "extent_type")


@query(f"""SELECT trim(k) AS raw_type, count(*) AS n FROM (SELECT {_KINDS} AS k FROM supplier) WHERE k IS NULL OR lower(trim(k)) IN ('ruin', 'camp') GROUP BY 1""")
def layer_unknown_terms(spark, d):
    rows = layers.boundaries(_outlines(spark, d), CITE, date(2020, 1, 1))
    return layers.unknown_terms(rows, "raw_type", layers.TYPE_MAP)


@query(f"""WITH {NATIONS}, {CUSTOMERS}, own AS (SELECT pid, min(k) AS k FROM points JOIN nations ON {INSIDE} GROUP BY pid)
SELECT CASE WHEN c_custkey % 5 <> 0 THEN 'P' || c_custkey ELSE regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') END AS locality_id, coalesce(CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END, CASE WHEN c_custkey % 2 = 0 THEN 'Z' END) AS oslo_area,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS value, CASE WHEN c_custkey % 3 = 1 THEN 'counted with ' || c_mktsegment END AS note, c_custkey % 4 = 0 AS in_east_jerusalem
FROM customer LEFT JOIN own ON c_custkey = pid WHERE c_custkey % 11 <> 0""")
def layer_localities(spark, d):
    """Communities with the class of the polygon that holds them, else the one that their file says."""
    k = F.col("c_custkey")
    figure = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit(" counted with "), "c_mktsegment")).otherwise("NA")
    fields = {"Region": F.when(k % 11 == 0, "Gaza Strip").otherwise("West Bank"), "PCBS_NAME": F.col("c_name"), "PCODE": F.when(k % 5 != 0, F.concat(F.lit("P"), k.cast("string"))), "pop2017": figure, "EJ": (k % 4 == 0).cast("int"), "Oslo_Areas": F.when(k % 2 == 0, "Z").otherwise("")}
    points = customer_points(spark, d).select(F.col("pid").alias("c_custkey"), _point(F.col("x"), F.col("y")).alias("geom"))
    records = table(spark, d, "customer").join(points, "c_custkey").select(k.alias("ord"), _map(**fields).alias("attributes"), "geom")
    letters = F.array(*[F.lit(v) for v in "ABC"])
    zones = nation_polygons(spark, d).select(F.col("fid").alias("ord"), F.element_at(letters, (F.col("fid") % 3 + 1).cast("int")).alias("oslo_class"), "geom")
    told = F.get("population", F.lit(0))
    return layers.localities(records, zones, CITE).select("locality_id", "oslo_area", told["value"].alias("value"), told["note"].alias("note"), "in_east_jerusalem")


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey * 3 % 1000 AS total, c_custkey * 7 % 1100 AS grp FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0)
SELECT 'pom-' || k AS locality_id, 2 + CASE WHEN grp > total THEN 0 ELSE 1 END AS n_figures, grp > total AS figures_conflict, k % 4 = 1 AND k % 5 < 3 AS depopulated_1948, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS n_refs, k % 4 = 1 AND k % 5 < 3 AS gone FROM r""")
def layer_historic(spark, d):
    """Localities of a delimited file: census figures, contradictions withheld, loss by state and year."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    status = F.when(k % 4 == 1, "Depopulated & built over").when(k % 4 == 2, "Built up").otherwise("")
    rows = table(spark, d, "customer").select(
        text(k).alias("id"), F.col("c_name").alias("name_en"), none.alias("name_ar"), F.lit(" ").alias("name_he"), F.when(k % 13 == 0, "n/a").otherwise(text((k % 300) / 10.0)).alias("lng"), text((k % 70) / 10.0).alias("lat"),
        F.when(k % 17 == 0, "Sinai").otherwise("Gaza").alias("district_1945"), none.alias("subdistrict_1945"), F.format_number(k * 3 % 1000 + 0, 0).alias("pop_1945"), text(k * 7 % 1100).alias("pal_1945"), F.lit("no figure").alias("jsh_1945"),
        F.lit("1,922").alias("pop_1922"), F.lit("").alias("pop_1931"), none.alias("pop_2016"), status.alias("change_2016"), F.concat(text(1946 + k % 5 + F.when(k % 5 < 3, 1).otherwise(20)), F.lit("-05-14")).alias("end"),
        F.when(k % 2 == 1, "Beit").otherwise("").alias("url_pr"), text(k).alias("id_zo"), none.alias("slug"), none.alias("grp_1945"), none.alias("grp_2016"),
    )
    out = layers.historic(rows, CITE)
    return out.select("locality_id", F.size("population").alias("n_figures"), "figures_conflict", "depopulated_1948", F.size("refs").alias("n_refs"), (F.col("mechanism") == "depopulation_1948").eqNullSafe(True).alias("gone"))


@query("""WITH s AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Sub-Station' WHEN 1 THEN 'Sub-Station' WHEN 2 THEN 'Clinic' ELSE 'Unspecified' END AS facility_type, s_suppkey % 7 <> 0 AND s_suppkey % 9 <> 0 AS usable FROM supplier)
SELECT facility_type, count(*) FILTER (WHERE usable) AS plotted, count(*) FILTER (WHERE NOT usable) AS withheld FROM s GROUP BY 1""")
def layer_facilities(spark, d):
    """Facilities with usable positions are plotted, the others withheld; aliases are one type."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "Sub Station").when(k % 4 == 1, "Sub-Station").when(k % 4 == 2, " Clinic ").otherwise("")
    points = supplier_points(spark, d).select(F.col("sid").alias("s_suppkey"), "x", "y")
    geom = F.when(k % 9 != 0, _point(F.when(k % 7 == 0, F.lit(-1.7976931348623157e308)).otherwise(F.col("x")), F.col("y")))
    records = table(spark, d, "supplier").join(points, "s_suppkey").select(k.alias("ord"), _map(name=F.col("s_name"), Type=kind, District=F.lit("d")).alias("attributes"), geom.alias("geom"), F.lit("EPSG:4326").alias("source_crs"))
    found = layers.facilities(records, CITE, "operator")
    every = found["plotted"].select("ord", "facility_type").unionByName(found["withheld"].select("ord", F.lit(None).cast("string").alias("facility_type")))
    kinds = F.when(F.col("ord") % 4 < 2, "Sub-Station").when(F.col("ord") % 4 == 2, "Clinic").otherwise("Unspecified")
    counted = every.select(kinds.alias("facility_type"), F.col("facility_type").alias("shown")).groupBy("facility_type")
    return counted.agg(F.count_if(F.col("shown") == F.col("facility_type")).alias("plotted"), F.count_if(F.col("shown").isNull()).alias("withheld"))


@query("""WITH p AS (SELECT p_partkey AS ord, p_name, CASE WHEN p_partkey % 5 <> 0 THEN CAST(900 + p_partkey % 40 AS VARCHAR) END AS zone, DATE '1970-01-01' + CAST(p_partkey % 9000 AS INTEGER) AS day, p_partkey % 6 <> 0 AS signed FROM part)
SELECT 'zone' AS layer, ord, coalesce('Firing zone ' || zone, 'Firing zone (unnumbered)') AS name, CASE WHEN signed THEN day END AS day FROM p
UNION ALL SELECT 'village', ord, CASE WHEN ord % 7 = 0 THEN 'Unnamed village' ELSE p_name END, DATE '2020-01-01' FROM p
UNION ALL SELECT 'municipal', ord, CASE WHEN ord % 8 = 0 THEN 'Unnamed municipality' ELSE p_name END, DATE '2020-01-01' FROM p
UNION ALL SELECT 'neighbourhood', ord, p_name, DATE '2020-01-01' FROM p UNION ALL SELECT 'barrier', ord, NULL, DATE '2020-01-01' FROM p""")
def layer_zones(spark, d):
    """Zones with the day that their order was signed, else the file's; garbled and blank names have a text of their own."""
    k = F.col("p_partkey")
    signed = F.when(k % 6 != 0, F.date_add(F.lit("1970-01-01").cast("date"), (k % 9000).cast("int")).cast("string"))
    fields = {
        "FIRE_NAME": F.when(k % 5 != 0, (900 + k % 40).cast("string")).otherwise("--- "), "SIGN_DATE": signed, "VNAME": F.when(k % 7 == 0, F.lit("��")).otherwise(F.col("p_name")),
        "NAME": F.when(k % 8 == 0, F.lit("  ")).otherwise(F.col("p_name")), "Neighbourh": F.col("p_name"), "DISTRICT": F.col("p_type"),
    }
    records = _squares(spark, d).select("ord", _map(**fields).alias("attributes"), "geom", "source_crs")
    made = {
        "zone": layers.firing_zones(records, CITE), "village": layers.village_boundaries(records, CITE), "municipal": layers.gaza_municipal(records, CITE, "x"),
        "neighbourhood": layers.gaza_neighbourhoods(records, CITE, "x")[0], "barrier": layers.barrier(records, CITE).withColumn("name", F.lit(None).cast("string")),
    }
    out = None
    for name, rows in made.items():
        part = rows.select(F.lit(name).alias("layer"), "ord", "name", F.get("evidence", F.lit(0))["document_date"].cast("date").alias("day"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 3 <> 0) AS with_district, count(*) FILTER (WHERE p_partkey % 4 = 1) AS with_community, count(*) AS with_arabic FROM part""")
def layer_neighbourhood_stats(spark, d):
    k = F.col("p_partkey")
    fields = {"Neighbourh": F.col("p_name"), "DISTRICT": F.when(k % 3 != 0, F.col("p_type")), "Communithy": F.when(k % 4 == 1, "c").otherwise(""), "NameARB": F.col("p_brand")}
    return layers.gaza_neighbourhoods(_squares(spark, d).select("ord", _map(**fields).alias("attributes"), "geom", "source_crs"), CITE, "x")[1]


@query("""SELECT c_custkey AS locality_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey + 10 END AS pop_1945_total, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END AS pop_1945_palestinian,
  coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey + 10 END, 0) AS size, CASE WHEN c_custkey % 2 = 0 THEN c_name || chr(10) || c_mktsegment ELSE c_name END AS label, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS oral_history_count FROM customer""")
def client_localities(spark, d):
    """Flat rows with the figures that symbols are sized by; zero figures and empty lists don't count."""
    k = F.col("c_custkey")
    entry = lambda year, value, group: F.struct(F.lit(year).alias("year"), value.cast("bigint").alias("value"), F.lit(group).cast("string").alias("grp"))
    population = F.array(entry(1931, F.lit(5), None), entry(1945, F.when(k % 3 != 0, k + 10).otherwise(0), ""), entry(1945, F.when(k % 5 == 0, k + 1), "Palestinian"), entry(1945, F.lit(99), None))
    population = F.when(k % 3 == 0, F.slice(population, 1, 3)).otherwise(population)
    heard = F.array_repeat(F.struct(F.lit("t").alias("title")), (k % 4).cast("int"))
    rows = table(spark, d, "customer").select(k.alias("locality_id"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("arabic"), population.alias("population"), heard.alias("oral_histories"))
    out = flat.locality_rows(rows)
    return out.select("locality_id", "pop_1945_total", "pop_1945_palestinian", flat.symbol_size(out).alias("size"), flat.label(F.col("name"), F.col("names.arabic")).alias("label"), "oral_history_count")


@query("""SELECT 'entity' AS kind, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, NULL AS category, 9 AS n_columns FROM supplier
UNION ALL SELECT 'incident', CAST(event_id AS VARCHAR), event_type, CASE WHEN value > 50 THEN 'high' END, 13 FROM events""")
def client_rows(spark, d):
    """Entities and incidents in the order of a client's columns; what a source lacks is null."""
    entities = flat.entity_rows(table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_name").alias("name")))
    incidents = flat.incident_rows(table(spark, d, "events").select(F.col("event_id").cast("string").alias("incident_id"), F.col("event_type").alias("title"), F.when(F.col("value") > 50, "high").alias("categories")))
    one = entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("names.primary").alias("name"), F.col("district").alias("category"), F.lit(len(entities.columns)).alias("n_columns"))
    return one.unionByName(incidents.select(F.lit("incident").alias("kind"), F.col("incident_id").alias("id"), F.col("title").alias("name"), F.col("categories").alias("category"), F.lit(len(incidents.columns)).alias("n_columns")))


@query("""SELECT CAST(min(year(CAST(ts AS DATE))) AS INTEGER) AS first_year FROM events""")
def client_first_year(spark, d):
    step = F.struct(F.to_date("ts").alias("valid_from"))
    return flat.first_year(table(spark, d, "events").select(F.array(step, F.struct(F.lit(None).cast("date").alias("valid_from"))).alias("stage_history")))


@query("""SELECT o_orderkey, round(o_totalprice / nullif(last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6) AS share FROM orders""")
def client_relative_series(spark, d):
    return flat.relative_to_last(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", F.round("share", 6).alias("share"))


@query("""SELECT doc_id, len(string_split(text, ' ')) AS n, string_split(text, ' ')[1] AS first_word, CAST(len(string_split(text, ' ')[1]) AS INTEGER) AS first_length FROM documents""")
def client_zipped_lists(spark, d):
    words = F.split("text", " ")
    pairs = flat.zipped(["word", "length"], words, F.transform(words, F.length))
    rows = table(spark, d, "documents").select("doc_id", pairs.alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0))["word"].alias("first_word"), F.get("p", F.lit(0))["length"].alias("first_length"))


@query(f"""WITH {NATIONS} SELECT min(x0) AS x0, min(y0) AS y0, max(CASE WHEN k % 7 = 3 THEN x0 + 9.5 ELSE x0 + 2 END) AS x1, max(y0 + 2) AS y1 FROM nations""")
def client_layer_box(spark, d):
    return flat.layer_box(nation_polygons(spark, d), (34.0, 31.0, 36.0, 33.0))


@query(f"""WITH {CUSTOMERS} SELECT pid, x, y FROM points""")
def client_points(spark, d):
    at = flat.point_of(F.col("geom"))
    return customer_points(spark, d).select("pid", _point(F.col("x"), F.col("y")).alias("geom")).select("pid", at["x"].alias("x"), at["y"].alias("y"))


@query("""SELECT s_suppkey AS id, s_name AS name, 0 AS layer FROM supplier WHERE s_suppkey = 7 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7)""")
def feature_by_id(spark, d):
    """The first layer that has the id answers."""
    first = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    second = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return search.by_id([first, second], "7", ["name"]).select(F.col("id").cast("bigint").alias("id"), "name", "layer")


@query("""WITH g AS (SELECT doc_id % 500 AS slug, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1)
SELECT p_partkey, coalesce(n, 0) AS n_interviews, first_id FROM part LEFT JOIN g ON g.slug = p_partkey % 700""")
def interviews_by_slug(spark, d):
    """Documents as interviews of the villages that their slug names; villages without any stay."""
    villages = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 700).cast("string").alias("slug"))
    heard = table(spark, d, "documents").select((F.col("doc_id") % 500).cast("string").alias("slug"), F.col("doc_id").alias("interview_id"), "lang")
    found = tables.by_slug(villages, heard)
    return found.select("p_partkey", F.coalesce(F.size("oral_histories"), F.lit(0)).cast("long").alias("n_interviews"), F.get("oral_histories", F.lit(0))["interview_id"].alias("first_id"))


def _utm_sql() -> str:
    """Snyder's inverse series on the sphere's and ellipsoid's constants, written out once more."""
    e2 = 2 / 298.257223563 - 1 / 298.257223563**2
    e1 = (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    ep = e2 / (1 - e2)
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    return f"""WITH p AS (SELECT c_custkey AS pid, CAST(650000 + c_custkey * 37 % 90000 AS DOUBLE) AS x, CAST(3450000 + c_custkey * 91 % 160000 AS DOUBLE) AS y FROM customer),
  m AS (SELECT *, y / {d(0.9996)} / {d(6378137.0 * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))} AS mu FROM p),
  f AS (SELECT *, mu + {d(3 * e1 / 2 - 27 * e1**3 / 32)} * sin(2 * mu) + {d(21 * e1**2 / 16 - 55 * e1**4 / 32)} * sin(4 * mu) + {d(151 * e1**3 / 96)} * sin(6 * mu) + {d(1097 * e1**4 / 512)} * sin(8 * mu) AS phi FROM m),
  t AS (SELECT *, {d(ep)} * pow(cos(phi), 2) AS c, pow(tan(phi), 2) AS t, {d(6378137.0)} / sqrt(1 - {d(e2)} * pow(sin(phi), 2)) AS n, {d(6378137.0 * (1 - e2))} / pow(1 - {d(e2)} * pow(sin(phi), 2), 1.5) AS r FROM f),
  u AS (SELECT *, (x - 500000) / (n * {d(0.9996)}) AS w FROM t)
SELECT pid, round(degrees((w - (1 + 2 * t + c) * pow(w, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {d(ep)} + 24 * t * t) * pow(w, 5) / 120) / cos(phi)) + 33, 6) AS lon,
  round(degrees(phi - (n * tan(phi) / r) * (w * w / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {d(ep)}) * pow(w, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {d(ep)} - 3 * c * c) * pow(w, 6) / 720)), 6) AS lat FROM u"""


@query(_utm_sql())
def utm_positions(spark, d):
    """Metres of a zone as degrees."""
    k = F.col("c_custkey")
    lon, lat = crs.to_wgs84((650000 + k * 37 % 90000).cast("double"), (3450000 + k * 91 % 160000).cast("double"), "EPSG:32636")
    return table(spark, d, "customer").select(k.alias("pid"), lon.alias("lon"), lat.alias("lat"))


@query("""WITH t AS (SELECT * FROM (VALUES ('layer 0', 'first'), ('layer 1', 'second'), ('layer 2', 'third'), ('layer 9', 'none')) v(extent_type, definition))
SELECT t.extent_type, any_value(t.definition) AS definition, count(p_partkey) AS n, count(p_partkey) * 5 AS before, count(p_partkey) * 5 AS after FROM t LEFT JOIN part ON 'layer ' || CAST(p_partkey % 3 AS VARCHAR) = t.extent_type GROUP BY 1""")
def published_extents(spark, d):
    """Features by extent type with their vertices before and after lines are simplified; empty types stay."""
    features = part_rectangles(spark, d).withColumn("extent_type", F.concat(F.lit("layer "), F.col("layer").cast("string")))
    definitions = spark.createDataFrame([("layer 0", "first"), ("layer 1", "second"), ("layer 2", "third"), ("layer 9", "none")], "extent_type string, definition string")
    out = build.extents(features, definitions)["layers"]
    return out.select("extent_type", "definition", F.col("n").cast("long").alias("n"), F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))
