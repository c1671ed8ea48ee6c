"""Queries of single values, spellings, gazetteer tiers and the search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.config import TYPE_MAP
from terrane.functions import dates, values
from terrane.functions import text as T
from terrane.operators import gazetteer, search
from terrane.plans import build
from terrane.plans.registry import query
from terrane.session import table


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS filled, p_partkey % 2 <> 0 AS no_list, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey + CAST(0.5 AS DOUBLE) END AS coordinate,
  p_partkey % 3 < 2 AS gone, CASE WHEN p_partkey % 3 < 2 AND 1940 + p_partkey % 15 BETWEEN 1947 AND 1950 THEN 'depopulation_1948' END AS mechanism, CASE WHEN p_partkey % 2 = 0 THEN 'then' ELSE 'now' END AS shown,
  p_partkey % 3 <> 0 AS off, CASE p_partkey % 5 WHEN 0 THEN 'settlement' WHEN 1 THEN 'outpost' END AS kind FROM part""")
def value_rules(spark, d):
    k = F.col("p_partkey")
    gone = values.depopulation(F.when(k % 3 == 0, "Depopulated").when(k % 3 == 1, "Abandoned").otherwise("Other"), F.concat((1940 + k % 15).cast("string"), F.lit("-05")), ("Depopulated", "Abandoned"))
    return table(spark, d, "part").select(
        k.alias("p_partkey"),
        values.drop_empty(F.when(k % 3 == 0, "").otherwise(F.col("p_brand")), "string").alias("filled"),
        values.drop_empty(F.array_compact(F.array(F.when(k % 2 == 0, F.col("p_brand")))), "array").isNull().alias("no_list"),
        values.parsed_coordinate(F.when(k % 4 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(".5")))).alias("coordinate"),
        gone["depopulated"].alias("gone"), gone["mechanism"].alias("mechanism"),
        values.shown_position(True, F.when(k % 2 == 0, "then"), F.lit("now")).alias("shown"),
        values.not_true(F.when(k % 3 == 0, True).when(k % 3 == 1, False)).alias("off"),
        values.vocabulary(F.when(k % 5 == 0, " SETTLEMENT ").when(k % 5 == 1, "Outpost").otherwise(F.col("p_brand")), TYPE_MAP).alias("kind"),
    )


@query("""SELECT o_orderkey, 4 AS stage, CAST(o_orderdate AS DATE) AS since, CAST(o_orderdate AS DATE) + 200 <= DATE '1997-12-31' OR o_orderkey % 3 = 0 OR year(CAST(o_orderdate AS DATE) + 100) <= 1997 AS visible,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def stage_minimum(spark, d):
    k, own = F.col("o_orderkey"), F.to_date("o_orderdate")
    least = dates.minimum_stage(4, own, F.lit(None).cast("string"))
    history = F.array(F.struct(F.lit(2).alias("stage"), F.date_add(own, 200).alias("valid_from")))
    raw = F.when(k % 4 == 0, "7/13/2000").otherwise(F.date_format(own, "dd/MM/yyyy"))
    return table(spark, d, "orders").select(
        "o_orderkey", least[0]["stage"].alias("stage"), least[0]["valid_from"].alias("since"),
        dates.visible_extent(history, F.when(k % 3 != 0, F.date_add(own, 100)), 1997).alias("visible"), dates.parse_day_first(raw).alias("day"),
    )


_SPELLINGS = ("Bayt Dayr", "Khirbat Shaykh", "Qaryat Om Jabal", "Plain Name")
_ARABIC = ("مَدِينَة القدس", "أبو إسْنان", "رؤى  الآن", "قرية")
_HEBREW = ("שָׁלוֹם  עִיר", "בית", "תֵּל אָבִיב", "כפר")


@query(f"""WITH s AS (SELECT s_suppkey AS k, s_name, [{", ".join(f"'{w}'" for w in _ARABIC)}][s_suppkey % 4 + 1] AS a, [{", ".join(f"'{w}'" for w in _HEBREW)}][s_suppkey % 4 + 1] AS h FROM supplier)
SELECT k AS s_suppkey, ['beit deir', 'khirbet sheikh', 'qariat umm jabel', 'plain name'][k % 4 + 1] AS folded, trim(regexp_replace(translate(regexp_replace(a, '[\u064b-\u0670\u065f\u0640]', '', 'g'), 'أإآٱةىؤئ', 'ااااهيوي'), '\\s+', ' ', 'g')) AS arabic,
  trim(regexp_replace(regexp_replace(h, '[\u0591-\u05c7]', '', 'g'), '\\s+', ' ', 'g')) AS hebrew, s_name || ' - Upper Part|' || s_name || '|Upper Part' AS variants, format('{{:,}}.0 km²', k * 1000) AS area FROM s""")
def name_forms(spark, d):
    k = F.col("s_suppkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select(
        "s_suppkey", T.fold_transliteration(T.normalise(pick(_SPELLINGS))).alias("folded"), T.normalise_arabic(pick(_ARABIC)).alias("arabic"), T.normalise_hebrew(pick(_HEBREW)).alias("hebrew"),
        F.array_join(T.name_variants(F.concat("s_name", F.lit(" - Upper Part")), F.lit(None).cast("string")), "|").alias("variants"), T.square_kilometres(k * 1e9).alias("area"),
    )


_PLACES = tuple(f"{a} {b}" for a in ("olive", "harbour", "mountain", "valley", "river", "meadow", "castle", "garden") for b in ("heights", "fields", "springs", "stones", "gates"))


def _places(spark, d, most=40):
    """Forty places, made of the nations' keys; two of them share a name."""
    k = F.explode(F.sequence(F.lit(0), F.lit(39)))
    rows = table(spark, d, "region").agg(F.count("*").alias("_n")).select(k.alias("k"))
    name = F.element_at(F.array(*map(F.lit, _PLACES)), F.when(F.col("k") == 39, 1).otherwise(F.col("k") + 1).cast("int"))
    return rows.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("locality_id"), F.col("k").alias("ord"), name.alias("name"), F.lit(None).cast("string").alias("arabic"), F.array().cast("array<string>").alias("transliterations"), F.lit(35.0).alias("x"), F.col("k").cast("double").alias("y"))


@query("""SELECT doc_id AS incident_id, CASE WHEN doc_id % 7 = 0 THEN 'unresolved' WHEN doc_id % 5 = 0 THEN 'unresolved' WHEN doc_id % 40 IN (0, 39) THEN 'ambiguous' ELSE 'matched' END AS confidence,
  CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 40 NOT IN (0, 39) THEN 'p' || (doc_id % 40) END AS matched_locality_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'body' ELSE 'title' END AS matched_from,
  doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 40 NOT IN (0, 39) AS shown FROM documents""")
def incident_tiers(spark, d):
    """Reports that name a place in the title, only in the body, or none; periodic ones; and a name that two places have."""
    k = F.col("doc_id")
    place = F.element_at(F.array(*map(F.lit, _PLACES)), F.when(k % 40 == 39, 1).otherwise(k % 40 + 1).cast("int"))
    named = F.when(k % 5 == 0, F.lit("no place at all")).otherwise(F.concat(F.lit("Soldiers at "), F.initcap(place), F.lit(", again")))
    records = table(spark, d, "documents").select(
        k.alias("incident_id"), F.when(k % 3 == 0, "Something happened").otherwise(named).alias("title"), F.when(k % 3 == 0, named).alias("body"), F.when(k % 7 == 0, "periodic").otherwise("field_story").alias("record_type"),
    )
    places = _places(spark, d)
    found = gazetteer.incidents(records, gazetteer.index(places), places)
    shown = gazetteer.renderable(found).select("incident_id").withColumn("shown", F.lit(True))
    return found.join(shown, "incident_id", "left").select("incident_id", "confidence", "matched_locality_id", "matched_from", F.coalesce("shown", F.lit(False)).alias("shown"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey % 40 AS name, CAST(p_partkey * 11 % 23 AS DOUBLE) * CAST(0.006 AS DOUBLE) AS y,
    row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 10 <> 3),
  walk AS (SELECT name, n, k, y AS held, TRUE AS kept FROM e WHERE n = 1
    UNION ALL SELECT w.name, e.n, e.k, CASE WHEN abs(e.y - w.held) * 111320 > 2500 THEN e.y ELSE w.held END, abs(e.y - w.held) * 111320 > 2500 FROM walk w JOIN e ON e.name = w.name AND e.n = w.n + 1)
SELECT 's' || k AS id, 1 AS part FROM walk WHERE kept UNION ALL SELECT 'p' || r.range, 0 FROM range(0, 40) r""")
def search_index_entries(spark, d):
    """Localities, and settlements without those near the last one kept of their name or unidentified."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, _PLACES)), (k % 40 + 1).cast("int"))
    entities = table(spark, d, "part").select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), k.alias("ord"), F.when(k % 10 == 3, "Unidentified settlement (x)").otherwise(name).alias("name"), F.lit(35.0).alias("x"), ((k * 11 % 23).cast("double") * 0.006).alias("y"), F.lit("settlement").alias("type"),
    )
    return search.build(_places(spark, d).withColumnRenamed("locality_id", "id"), entities).select("id", "part")


_DAMAGE = {"water": ("well", "cistern"), "home": ("house",)}


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 40 AS place, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'raid' ELSE 'well blocked' END AS kind, o_orderkey % 3 = 0 AS house FROM orders)
SELECT 'p' || place AS locality_id, count(*) AS record_count, count(*) FILTER (WHERE kind = 'raid' AND NOT house) AS uncategorised, min(day) AS first_recorded, max(day) AS last_recorded,
  count(*) FILTER (WHERE kind <> 'raid') AS water, count(*) FILTER (WHERE house) AS home FROM r WHERE place NOT IN (0, 39) GROUP BY place""")
def destruction_by_place(spark, d):
    k = F.col("o_orderkey")
    place = F.element_at(F.array(*map(F.lit, _PLACES)), F.when(k % 40 == 39, 1).otherwise(k % 40 + 1).cast("int"))
    records = table(spark, d, "orders").select(
        place.alias("village"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"), F.when(k % 2 == 0, "raid").otherwise("well blocked").alias("violation_type"), F.when(k % 3 == 0, "House").alias("property_damage_type"),
    )
    placed = build.destruction(records, _places(spark, d), _DAMAGE)["placed"]
    of = lambda label: F.coalesce(F.get(F.filter("resource_counts", lambda e: e["value"] == label), F.lit(0))["n"], F.lit(0))
    return placed.select("locality_id", "record_count", "uncategorised", "first_recorded", "last_recorded", of("water").alias("water"), of("home").alias("home"))
