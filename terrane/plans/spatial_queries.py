"""Queries of the geometry, containment and coverage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import crs
from terrane.functions import geometry as G
from terrane.operators import coverage, resolve, spatial
from terrane.plans import build
from terrane.plans.derived import CUSTOMERS, INSIDE, NATIONS, RECTANGLES, SUPPLIERS, customer_points, nation_polygons, part_rectangles, supplier_points
from terrane.plans.registry import query
from terrane.session import table


@query(f"""WITH {NATIONS}, {CUSTOMERS},
  placed AS (SELECT pid, min(k) AS k FROM points JOIN nations ON {INSIDE} GROUP BY pid),
  named AS (SELECT coalesce(placed.k, -1) AS fid FROM points LEFT JOIN placed USING (pid))
SELECT fid, count(*) AS n_points, round(count(*) * 100.0 / (SELECT count(*) FROM points), 4) AS pct FROM named GROUP BY fid""")
def spatial_contains_first(spark, d):
    placed = spatial.first_match(customer_points(spark, d), nation_polygons(spark, d), "pid", "fid", "fid", F.lit(-1))
    counted = placed.groupBy("fid").agg(F.count("*").alias("n_points"))
    whole = counted.agg(F.sum("n_points").alias("whole"))
    return counted.join(F.broadcast(whole), F.lit(True), "left").select("fid", "n_points", F.round(F.col("n_points") * 100.0 / F.col("whole"), 4).alias("pct"))


@query(f"""WITH {NATIONS}, {SUPPLIERS},
  found AS (SELECT k, count(DISTINCT sid % 40) AS n, min(sid % 40) AS one FROM nations JOIN suppliers ON {INSIDE} GROUP BY k)
SELECT nations.k AS fid, CAST(coalesce(n, 0) AS INTEGER) AS n_names, CASE WHEN n = 1 THEN one END AS given_name FROM nations LEFT JOIN found USING (k)""")
def spatial_contains_exactly_one(spark, d):
    points = supplier_points(spark, d).withColumn("nm", F.col("sid") % 40)
    return spatial.exactly_one(nation_polygons(spark, d), points, "fid", "nm").select("fid", "n_names", "given_name")


@query(f"""WITH {NATIONS}, {CUSTOMERS},
  placed AS (SELECT pid, any_value(declared) AS declared, min(k) AS k FROM points JOIN nations ON {INSIDE} GROUP BY pid),
  counted AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE placed.declared = placed.k) AS agree FROM placed GROUP BY k)
SELECT nations.k AS fid, coalesce(n, 0) AS n_points, coalesce(n, 0) AS labelled, coalesce(agree, 0) AS agreeing FROM nations LEFT JOIN counted USING (k)""")
def spatial_count_zero_kept(spark, d):
    """Labels agree when one holds the other; padded names make that equality here."""
    points = customer_points(spark, d).withColumn("label", F.concat(F.lit("<"), F.col("declared").cast("string"), F.lit(">")))
    polygons = nation_polygons(spark, d).withColumn("tag", F.concat(F.lit("<"), F.col("fid").cast("string"), F.lit(">")))
    return spatial.counts(points, polygons, "pid", "fid", "fid", "label", "tag").select("fid", "n_points", "labelled", "agreeing")


@query(f"""WITH {NATIONS}, {CUSTOMERS} SELECT pid FROM points WHERE NOT EXISTS (SELECT 1 FROM nations WHERE {INSIDE})""")
def spatial_anti(spark, d):
    return spatial.outside(customer_points(spark, d), nation_polygons(spark, d), "pid").select("pid")


@query(f"""WITH {NATIONS}, {SUPPLIERS} SELECT sid, CASE WHEN k IS NULL THEN 'unknown' WHEN {INSIDE} THEN 'applied' ELSE 'refused' END AS outcome
FROM suppliers LEFT JOIN nations ON CASE WHEN sid % 9 = 0 THEN 99 ELSE declared END = k""")
def anchor_verify(spark, d):
    claims = supplier_points(spark, d).withColumn("fid", F.when(F.col("sid") % 9 == 0, 99).otherwise(F.col("declared")).cast("int"))
    return spatial.verify_anchors(claims, nation_polygons(spark, d), "fid").select("sid", "outcome")


@query(f"""WITH {NATIONS} SELECT k AS fid, CASE WHEN k % 7 = 0 THEN 3.0 WHEN k % 7 = 3 THEN 4.25 ELSE 4.0 END::DOUBLE AS area,
  x0 + CAST(0.8 AS DOUBLE) AS cx, y0 + CAST(0.8 AS DOUBLE) AS cy, x0 AS west, y0 AS south, CASE WHEN k % 7 = 3 THEN x0 + 9.5 ELSE x0 + 2 END AS east, y0 + 2 AS north,
  CASE WHEN k % 7 IN (0, 3) THEN 10 ELSE 5 END AS n_vertices, TRUE AS closed FROM nations""")
def poly_area_centroid_bbox(spark, d):
    parts = F.col("geom.parts")
    rows = nation_polygons(spark, d).select("fid", parts.alias("p"), G.planar_area(parts).alias("area"), G.ring_center(parts).alias("c"), G.bounds(parts).alias("b"))
    return rows.select(
        "fid", F.round("area", 6).alias("area"), F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), F.col("b.x0").alias("west"), F.col("b.y0").alias("south"),
        F.col("b.x1").alias("east"), F.col("b.y1").alias("north"), G.vertex_count(F.col("p")).alias("n_vertices"), G.closed_rings(F.col("p")).alias("closed"),
    )


def _measures(spark, d):
    rects = part_rectangles(spark, d)
    extent = rects.groupBy().agg(F.lit(0).alias("fid"), F.lit(None).cast("date").alias("dated"))
    box = G.geometry("Polygon", F.array(F.array(G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))))
    layers = {"extent": extent.withColumn("geom", box)}
    return layers | {f"m{k}": rects.where(F.col("layer") == k).drop("layer") for k in range(3)}


_CELL_M = 1000.0
_GRID = """grid AS (SELECT CAST(1000 AS DOUBLE) / 111320 AS lat, CAST(1000 AS DOUBLE) / (CAST(111320 AS DOUBLE) * cos(radians(CAST(0.5 AS DOUBLE)))) AS lon),
  cells AS (SELECT r.range AS row, c.range AS col, (c.range + CAST(0.5 AS DOUBLE)) * lon AS x, (r.range + CAST(0.5 AS DOUBLE)) * lat AS y,
    lat * 111320 * (lon * 111320 * cos(radians((r.range + CAST(0.5 AS DOUBLE)) * lat))) / 1e6 AS km2
    FROM grid, range(0, 112) r, range(0, 112) c WHERE c.range < CAST(floor(1 / lon) AS INTEGER) + 1 AND r.range < CAST(floor(1 / lat) AS INTEGER) + 1)"""


def _subset_sql(where: str, year: str, dated_only: str) -> str:
    return f"""SELECT s.key AS subset_key, round(coalesce(sum(km2), 0), 2) AS km2,
      round(coalesce(sum(km2), 0) * 100 / (SELECT sum(km2) FROM cells WHERE x < 1 AND y < 1), 3) AS pct, {year} AS year, {dated_only} AS dated_only
    FROM (VALUES ('m0', [0]), ('m1', [1]), ('m2', [2]), ('m0+m1', [0, 1]), ('m0+m2', [0, 2]), ('m1+m2', [1, 2]), ('m0+m1+m2', [0, 1, 2])) s(key, ids)
    LEFT JOIN (SELECT row, col, any_value(km2) AS km2, list(DISTINCT CAST(layer AS INTEGER)) AS held FROM cells JOIN rects ON x >= x0 AND x < x0 + side AND y >= y0 AND y < y0 + side
      WHERE {where} GROUP BY row, col) c ON list_has_any(s.ids, c.held) GROUP BY s.key"""


@query(f"WITH {RECTANGLES}, {_GRID} SELECT subset_key, km2, pct FROM ({_subset_sql('TRUE', 'NULL', 'FALSE')})")
def coverage_union_subsets(spark, d):
    out = coverage.coverage(_measures(spark, d), "extent", _CELL_M)
    return out.select("subset_key", F.round("km2", 2).alias("km2"), F.round("pct", 3).alias("pct"))


@query(
    f"WITH {RECTANGLES}, {_GRID} "
    + " UNION ALL ".join(_subset_sql(f"dated IS NOT NULL AND year(dated) <= {y}", str(y), "TRUE") for y in (1980, 2000))
    + " UNION ALL " + _subset_sql("TRUE", "NULL", "FALSE")
)
def coverage_timeline(spark, d):
    out = coverage.timeline(_measures(spark, d), "extent", [1980, 2000], cell_m=_CELL_M)
    return out.select("subset_key", F.round("km2", 2).alias("km2"), F.round("pct", 3).alias("pct"), "year", "dated_only")


@query(f"""WITH {RECTANGLES}, {_GRID} SELECT subset_key, km2 FROM ({_subset_sql('TRUE', 'NULL', 'FALSE')})
WHERE subset_key = array_to_string(list_sort(['m2', 'm0']), '+')""")
def power_lookup(spark, d):
    table_ = coverage.coverage(_measures(spark, d), "extent", _CELL_M)
    return build.land_total(table_, ["m2", "m0", "m2"]).select("subset_key", F.round("km2", 2).alias("km2"))


@query(f"""WITH {CUSTOMERS}, {SUPPLIERS}, near AS (SELECT pid, sid, sqrt(pow((p.x - s.x) * (cos(radians(CAST(31.9 AS DOUBLE))) * 111320), 2) + pow((p.y - s.y) * 111320, 2)) AS m FROM points p, suppliers s),
  ranked AS (SELECT pid, sid, m, row_number() OVER (PARTITION BY pid ORDER BY m, sid) AS r FROM near WHERE m <= 2500)
SELECT pid, sid, round(m, 1) AS distance_m FROM ranked WHERE r = 1""")
def nearest_blocked_match(spark, d):
    found = resolve.nearest(customer_points(spark, d).select("pid", "x", "y"), supplier_points(spark, d).select("sid", "x", "y"), "pid", "sid", 2500.0)
    return found.select("pid", "sid", F.round("distance_m", 1).alias("distance_m"))


@query(f"""WITH {NATIONS}, {CUSTOMERS} SELECT pid, min(k) AS fid FROM points JOIN nations ON {INSIDE} GROUP BY pid""")
def topmost_hit(spark, d):
    return spatial.topmost(customer_points(spark, d).select("pid", "x", "y"), nation_polygons(spark, d), "pid", "fid", "fid")


@query("""WITH l AS (SELECT s_suppkey AS sid, s_suppkey % 7 AS h, CAST(s_suppkey % 3 AS DOUBLE) * CAST(0.00008 AS DOUBLE) AS g FROM supplier)
SELECT sid, CASE WHEN h = 0 THEN 2 WHEN g > 0.0001 THEN 5 ELSE 3 END AS n_line, 5 + (CASE WHEN g > 0.0001 THEN 1 ELSE 0 END) AS n_ring, 4 AS n_small FROM l""")
def simplify_counts(spark, d):
    """A peak of height h with two dents of depth g in its sides; a square with a bump of height g; a triangle that would vanish."""
    k = F.col("s_suppkey")
    h, g = (k % 7).cast("double") * 0.0004, (k % 3).cast("double") * 0.00008
    dent = F.when(h > 0, h / 2 + g).otherwise(F.lit(0.0))
    p = lambda x, y: G.point(F.lit(x), y if not isinstance(y, float) else F.lit(y))
    line = F.array(p(0.0, 0.0), p(1.0, dent), p(2.0, h), p(3.0, dent), p(4.0, 0.0))
    ring = F.array(p(0.0, 0.0), p(4.0, 0.0), p(4.0, 4.0), p(2.0, g + 4.0), p(0.0, 4.0), p(0.0, 0.0))
    small = F.array(p(0.0, 0.0), p(0.00001, 0.0), p(0.0, 0.00001), p(0.0, 0.0))
    rows = table(spark, d, "supplier").select(k.alias("sid"), F.array(F.array(line)).alias("line"), F.array(F.array(ring), F.array(small)).alias("rings"))
    thin = rows.select("sid", G.simplify(F.col("line"), 1e-4, polygon=False).alias("l"), G.simplify(F.col("rings"), 1e-4).alias("r"))
    return thin.select("sid", G.vertex_count(F.col("l")).alias("n_line"), F.size(F.col("r")[0][0]).alias("n_ring"), F.size(F.col("r")[1][0]).alias("n_small"))


@query("""SELECT n_regionkey AS region, count(*) AS n_parts, CAST(sum(CASE WHEN n_nationkey % 7 = 3 THEN 2 ELSE 1 END) AS BIGINT) AS parts FROM nation GROUP BY 1""")
def multipart_assembly(spark, d):
    rows = nation_polygons(spark, d).withColumn("ord", F.col("fid"))
    whole = spatial.assembled(rows, "region")
    counted = rows.groupBy("region").agg(F.count("*").alias("n_parts"))
    return whole.join(counted, "region").select("region", "n_parts", F.size("geom.parts").cast("long").alias("parts"))


_EA = """ea AS (SELECT sqrt(CAST(0.0066943799901413165 AS DOUBLE)) AS e, CAST(0.0066943799901413165 AS DOUBLE) AS e2, cos(radians(CAST(31.9 AS DOUBLE))) / sqrt(1 - 0.0066943799901413165 * pow(sin(radians(CAST(31.9 AS DOUBLE))), 2)) AS k0)"""


def _q_sql(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"((1 - e2) * ({s} / (1 - e2 * {s} * {s}) - (1 / (2 * e)) * ln((1 - e * {s}) / (1 + e * {s}))))"


@query(f"""WITH {SUPPLIERS}, {_EA} SELECT sid, round(6378137 * k0 * radians(x - CAST(35.2 AS DOUBLE)), 2) AS east_m, round(6378137 * {_q_sql("y")} / (2 * k0), 2) AS north_m FROM suppliers, ea""")
def equal_area_position(spark, d):
    rows = supplier_points(spark, d)
    east, north = crs.equal_area(F.col("x"), F.col("y"))
    return rows.select("sid", F.round(east, 2).alias("east_m"), F.round(north, 2).alias("north_m"))


@query(f"""WITH {NATIONS}, {_EA}, strips AS (SELECT k, CASE WHEN k % 7 = 0 THEN 2 * ({_q_sql("y0 + 2")} - {_q_sql("y0")}) - ({_q_sql("y0 + 1.5")} - {_q_sql("y0 + 0.5")})
    WHEN k % 7 = 3 THEN 2 * ({_q_sql("y0 + 2")} - {_q_sql("y0")}) + 0.5 * ({_q_sql("y0 + 0.5")} - {_q_sql("y0")}) ELSE 2 * ({_q_sql("y0 + 2")} - {_q_sql("y0")}) END AS w FROM nations, ea)
SELECT k AS fid, round(6378137.0 * 6378137.0 / 2 * radians(w) / 1e6, 3) AS km2 FROM strips""")
def equal_area_polygons(spark, d):
    """Boxes, one with a hole and one with a second part: their ellipsoidal area has a closed form."""
    return nation_polygons(spark, d).select("fid", F.round(crs.area_m2(F.col("geom.parts"), 3) / 1e6, 3).alias("km2"))


@query(f"""WITH {NATIONS} SELECT CAST(region AS VARCHAR) AS kind, round(sum(CASE WHEN k % 7 = 0 THEN 3.0 WHEN k % 7 = 3 THEN 4.25 ELSE 4.0 END), 2)::DOUBLE AS km2, count(*) AS n,
  CAST(sum(CASE WHEN k % 7 = 3 THEN 2 ELSE 1 END) AS BIGINT) AS parts, round(sum(CASE WHEN k % 7 = 0 THEN 3.0 WHEN k % 7 = 3 THEN 4.25 ELSE 4.0 END) * 100 / 400.0, 2)::DOUBLE AS pct FROM nations GROUP BY region""")
def land_measures(spark, d):
    rows = nation_polygons(spark, d).withColumn("kind", F.col("region").cast("string")).withColumn("area_m2", G.planar_area(F.col("geom.parts")) * 1e6)
    return build.measures(rows, "kind", 400.0)


@query(f"""WITH {SUPPLIERS} SELECT sid, CAST(trunc((x - 5) / CAST(0.03 AS DOUBLE)) AS INTEGER) AS cell, round(CASE WHEN x < 2 THEN sqrt(pow(x - 2, 2) + pow(y - 3, 2)) WHEN x > 6 THEN sqrt(pow(x - 6, 2) + pow(y - 3, 2)) ELSE abs(y - 3) END, 6) AS off,
  round(x, 1) AS x1 FROM suppliers""")
def cells_and_segments(spark, d):
    """The block cell, cut toward zero; the distance from a level segment; rounded vertices."""
    x, y = F.col("x"), F.col("y")
    off = G.segment_distance(x, y, F.lit(2.0), F.lit(3.0), F.lit(6.0), F.lit(3.0))
    vertex = G.rounded(F.array(F.array(F.array(G.point(x, y)))), 1)[0][0][0]
    return supplier_points(spark, d).select("sid", G.block_cell(x - 5).alias("cell"), F.round(off, 6).alias("off"), vertex["x"].alias("x1"))
