"""Queries of whole operators chained: names carried over, series merged, invariants, GeoJSON."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import aggregates, explainers, quality, resolve, search
from terrane.plans.derived import CUSTOMERS, INSIDE, NATIONS, customer_points, nation_polygons
from terrane.plans.registry import query
from terrane.session import table
from terrane.sources import geojson


@query("""WITH e AS (SELECT o_custkey AS k, year(o_orderdate) AS y, o_orderkey AS v FROM orders),
  f AS (SELECT k, y, min(v) AS v FROM e WHERE v % 2 = 0 GROUP BY 1, 2), s AS (SELECT k, y, min(v) AS v FROM e WHERE v % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(f.k, s.k) AS entity, coalesce(f.y, s.y) AS year, coalesce(f.v, s.v) AS value FROM f FULL JOIN s ON f.k = s.k AND f.y = s.y""")
def population_union(spark, d):
    """Two series of one entity: the first entry of each year stays."""
    none = F.lit(None).cast("string")
    year = F.year("o_orderdate")
    rows = table(spark, d, "orders").groupBy("o_custkey", year.alias("year"), (F.col("o_orderkey") % 2).alias("odd")).agg(F.min("o_orderkey").alias("value"))
    entry = F.struct("year", "value", none.alias("grp"), none.alias("note"), none.alias("source_id"))
    lists = rows.groupBy("o_custkey").agg(*[F.array_compact(F.collect_list(F.when(F.col("odd") == k, entry))).alias(f"s{k}") for k in (0, 1)])
    merged = lists.select(F.col("o_custkey").alias("entity"), F.explode(resolve.merged_population(F.col("s0"), F.col("s1"))).alias("e"))
    return merged.select("entity", "e.year", "e.value")


@query("""WITH h AS (SELECT user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS stage, CAST(ts AS DATE) AS f, CAST(ts AS DATE) + 3 AS t FROM events)
SELECT user_id, max(stage) FILTER (WHERE f <= DATE '2024-01-15') AS reached, max(stage) FILTER (WHERE f <= DATE '2024-01-15' AND t >= DATE '2024-01-15') AS standing FROM h GROUP BY 1""")
def interval_state(spark, d):
    stage = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    begun = F.to_date("ts")
    day = F.lit(date(2024, 1, 15))
    return table(spark, d, "events").groupBy("user_id").agg(aggregates.reached(stage, begun, day).alias("reached"), aggregates.standing(stage, begun, F.date_add(begun, 3), day).alias("standing"))


@query("""WITH t AS (SELECT c_custkey AS k, c_custkey % 40 AS key, CAST(c_custkey % 9 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS y FROM customer), s AS (SELECT s_suppkey AS k, s_suppkey % 40 AS key, CAST(s_suppkey % 9 AS DOUBLE) * CAST(0.01 AS DOUBLE) AS y FROM supplier),
  near AS (SELECT t.k, s.k AS o FROM t JOIN s ON t.key = s.key AND abs(t.y - s.y) * 111320 <= 2500),
  first_ AS (SELECT k, min(o) AS o FROM near GROUP BY k)
SELECT 'c' || t.k AS locality_id, CASE WHEN t.k % 3 = 0 THEN 'own' WHEN o IS NOT NULL THEN 'h' || o END AS hebrew FROM t LEFT JOIN first_ USING (k)""")
def propagated_names(spark, d):
    words = F.array(*[F.lit(f"{a} {b}") for a in ("olive", "harbour", "mountain", "valley", "river", "meadow", "castle", "garden") for b in ("east", "north", "upper", "lower", "middle")])

    def rows(name, key, prefix, own):
        k = F.col(key)
        return table(spark, d, name).select(F.concat(F.lit(prefix), k.cast("string")).alias("locality_id"), k.alias("ord"), F.element_at(words, (k % 40 + 1).cast("int")).alias("name"), F.lit(35.0).alias("x"), ((k % 9).cast("double") * 0.01).alias("y"), own(k).alias("hebrew"))

    targets = rows("customer", "c_custkey", "c", lambda k: F.when(k % 3 == 0, "own"))
    sources = rows("supplier", "s_suppkey", "s", lambda k: F.concat(F.lit("h"), k.cast("string")))
    return resolve.propagate_names(targets, sources).select("locality_id", "hebrew")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'curated' WHEN p_partkey % 2 = 0 THEN p_brand END AS hebrew, p_partkey % 4 = 0 AS overridden FROM part""")
def curated_overrides(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when((F.col("p_partkey") % 2 == 0) & (F.col("p_partkey") % 4 != 0), F.col("p_brand")).alias("hebrew"))
    curated = table(spark, d, "part").where("p_partkey % 4 = 0 or p_partkey % 4 = 2").select("p_partkey", F.lit("curated").alias("hebrew"))
    return resolve.apply_overrides(rows, curated, "p_partkey").select("p_partkey", "hebrew", "overridden")


@query("""SELECT n_nationkey AS fid, CASE WHEN n_nationkey % 7 IN (0, 3) THEN 10 ELSE 5 END AS n_vertices, TRUE AS same FROM nation""")
def geojson_round_trip(spark, d):
    rows = nation_polygons(spark, d)
    text = rows.select("fid", "geom", geojson.geometry_json(F.col("geom")).alias("json"))
    back = text.select("fid", "geom", geojson.parsed_geometry(F.col("json")).alias("g"))
    return back.select("fid", G.vertex_count(F.col("g.parts")).alias("n_vertices"), (F.col("g.parts") == F.col("geom.parts")).alias("same"))


@query(f"""WITH {NATIONS}, {CUSTOMERS}
SELECT 'points are inside' AS invariant, (SELECT count(*) FROM points WHERE NOT EXISTS (SELECT 1 FROM nations WHERE {INSIDE})) AS violations
UNION ALL SELECT 'positions are unique', (SELECT count(*) FROM (SELECT x, y FROM points GROUP BY x, y HAVING count(*) > 1))
UNION ALL SELECT 'rings are closed', 0 UNION ALL SELECT 'within range', (SELECT count(*) FROM nations WHERE k % 7 = 3 AND x0 + 9.5 > 12)""")
def invariant_report(spark, d):
    points, polygons = customer_points(spark, d), nation_polygons(spark, d)
    return quality.report(
        {
            "points are inside": quality.points_outside(points, polygons, "pid"),
            "positions are unique": quality.shared_positions(points),
            "rings are closed": quality.open_rings(polygons),
            "within range": quality.out_of_range(polygons, 0, 0, 12, 12),
        }
    )


@query("""SELECT c_custkey AS id, trim(regexp_replace(lower(c_mktsegment || ' ' || c_name), '[^a-z0-9_]+', ' ', 'g')) || ' | ' || lower(c_mktsegment || ' ' || c_name) AS keys FROM customer""")
def search_keys(spark, d):
    name = F.concat_ws(" ", "c_mktsegment", "c_name")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), search.keys(name).alias("keys"))


@query("""SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['uncategorised'] ELSE l END) AS label FROM
  (SELECT list_distinct(list_filter([CASE WHEN value > 50 THEN 'high' END, CASE WHEN event_type = 'click' THEN 'click' END], lambda x: x IS NOT NULL)) AS l FROM events)) GROUP BY 1""")
def event_labels(spark, d):
    labels = F.array_compact(F.array(F.when(F.col("value") > 50, "high"), F.when(F.col("event_type") == "click", "click")))
    return aggregates.label_tally(table(spark, d, "events").select(labels.alias("labels")), "labels")


@query("""WITH c AS (SELECT conv_id, role, length(text) % 50 AS k FROM conversations WHERE text IS NOT NULL),
  cites AS (SELECT conv_id, role AS source_id, CAST(k AS VARCHAR) AS title FROM c UNION ALL SELECT conv_id, 'opening', CAST(conv_id % 7 AS VARCHAR) FROM c)
SELECT source_id, title, count(*) AS n_claims, count(DISTINCT conv_id) AS n_explainers FROM cites GROUP BY 1, 2""")
def explainer_citations(spark, d):
    """Conversations as explainers: each turn claims something and cites its role, and a nested source of the whole."""
    none = F.lit(None)

    def cite(source, title):
        return F.struct(source.alias("source_id"), title.cast("string").alias("title"), none.cast("string").alias("url"), none.cast("date").alias("document_date"), none.cast("date").alias("retrieved"), F.lit("").alias("note"))

    context = F.struct(F.struct(F.array(cite(F.lit("opening"), F.col("conv_id") % 7)).alias("evidence")).alias("within"))
    claim = F.struct("turn", "text", F.array(cite(F.col("role"), F.length("text") % 50)).alias("evidence"), context.alias("context"))
    rows = table(spark, d, "conversations").where("text is not null").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    hoisted, cited = explainers.published(rows)
    flat = hoisted.select("id", F.explode("claims").alias("c")).select("id", F.explode(F.concat("c.evidence_ref", "c.context.within.evidence_ref")).alias("evidence_id"))
    return flat.join(cited, "evidence_id").groupBy("source_id", "title").agg(F.count("*").alias("n_claims"), F.count_distinct("id").alias("n_explainers"))
