"""Queries of resolution, provenance, temporal state and conservation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from terrane.functions import dates, values
from terrane.functions import text as T
from terrane.operators import aggregates, provenance, resolve
from terrane.plans import build
from terrane.plans.derived import CUSTOMERS, customer_points
from terrane.plans.registry import query
from terrane.session import table

_CONFLICTS = """places AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'own-' ELSE 'pom-' END || c_custkey AS locality_id, c_custkey AS ord,
  'place ' || CAST(c_custkey % 4 AS VARCHAR) AS name, CAST(c_custkey % 500 AS DOUBLE) AS x, CAST(c_custkey % 7 AS DOUBLE) AS y FROM customer)"""


@query(f"""WITH {_CONFLICTS}, g AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE locality_id LIKE 'own-%') OVER w AS n_own,
    min(name) OVER w = max(name) OVER w AS alike, first_value(locality_id) OVER (PARTITION BY x, y ORDER BY (locality_id LIKE 'own-%') DESC, ord) AS best
  FROM places WINDOW w AS (PARTITION BY x, y))
SELECT locality_id, CASE WHEN n = 1 THEN 'keep' WHEN alike THEN CASE WHEN locality_id = best THEN 'keep' ELSE 'merge' END
    WHEN n_own = 1 THEN CASE WHEN locality_id LIKE 'own-%' THEN 'keep' ELSE 'withhold' END ELSE 'withhold' END AS decision,
  CASE WHEN n = 1 THEN locality_id WHEN alike OR n_own = 1 THEN best END AS survivor_id FROM g""")
def coord_conflicts(spark, d):
    k = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in ("zero olive", "one harbour", "two mountain", "three valley")])
    rows = table(spark, d, "customer").select(
        F.concat(F.when(k % 3 == 0, "own-").otherwise("pom-"), k.cast("string")).alias("locality_id"), k.alias("ord"),
        F.element_at(words, (k % 4 + 1).cast("int")).alias("name"), (k % 500).cast("double").alias("x"), (k % 7).cast("double").alias("y"),
    )
    return resolve.coordinate_conflicts(rows).select("locality_id", "decision", "survivor_id")


def _localities(spark, d, historic: bool):
    k = F.col("c_custkey")
    cast = lambda c, t: F.lit(c).cast(t)
    evidence = "array<struct<source_id:string,title:string,url:string,document_date:date,retrieved:date,note:string>>"
    keep = table(spark, d, "customer").where(k % 2 == (1 if historic else 0))
    place = F.floor(k / 2)
    return keep.select(
        F.concat(F.lit("pom-" if historic else "loc-"), k.cast("string")).alias("locality_id"), k.alias("ord"),
        F.concat(F.lit("Beit " if not historic else "Bayt "), F.regexp_replace(F.conv(place.cast("string"), 10, 26), "[0-9]", "q")).alias("name"),
        F.when(k % 5 == 0, F.concat(F.lit("ar"), k.cast("string"))).alias("arabic"), cast(None, "string").alias("hebrew"),
        F.array().cast("array<string>").alias("transliterations"), ((place % 300) * 0.1 + (0.001 if historic else 0.0)).alias("x"), (F.floor(place / 300) * 0.1).cast("double").alias("y"),
        F.when(k % 3 == 0, F.lit("north")).alias("district"), F.lit(False).alias("depopulated_1948"), cast(None, "string").alias("depopulated_date"),
        F.when(F.lit(historic), F.concat(F.lit("s"), k.cast("string"))).alias("slug"),
        F.array(F.struct(F.lit(1945 if historic else 2017).alias("year"), k.cast("bigint").alias("value"), cast(None, "string").alias("grp"), cast(None, "string").alias("note"), F.lit("src").alias("source_id"))).alias("population"),
        F.create_map(F.lit("wiki"), F.when(F.lit(historic), F.lit("old")).otherwise(F.lit("new"))).alias("refs"),
        F.array(F.struct(F.lit("his" if historic else "cur"), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None))).cast(evidence).alias("evidence"),
    )


@query("""WITH k AS (SELECT c_custkey AS k FROM customer), cur AS (SELECT k FROM k WHERE k % 2 = 0), his AS (SELECT k FROM k WHERE k % 2 = 1),
  both_ AS (SELECT cur.k AS k, his.k AS h FROM cur LEFT JOIN his ON cur.k + 1 = his.k)
SELECT 'loc-' || k AS locality_id, CASE WHEN k % 5 = 0 THEN 'ar' || k WHEN h % 5 = 0 THEN 'ar' || h END AS arabic, CASE WHEN k % 3 = 0 OR h % 3 = 0 THEN 'north' END AS district,
  CASE WHEN h IS NOT NULL THEN 's' || h END AS slug, CASE WHEN h IS NULL THEN 1 ELSE 2 END AS n_population, CASE WHEN h IS NULL THEN 'cur' ELSE 'cur,his' END AS cited, 'new' AS wiki, h IS NOT NULL AS moved FROM both_
UNION ALL SELECT 'pom-' || h.k, CASE WHEN h.k % 5 = 0 THEN 'ar' || h.k END, CASE WHEN h.k % 3 = 0 THEN 'north' END, 's' || h.k, 1, 'his', 'old', FALSE FROM his h LEFT JOIN cur ON cur.k + 1 = h.k WHERE cur.k IS NULL""")
def survivor_merge(spark, d):
    """Pairs come from keys here: names and positions are tested with fixtures."""
    current, historic = _localities(spark, d, False), _localities(spark, d, True)
    key = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    known = current.select("locality_id")
    pairs = historic.select(F.col("locality_id").alias("historic_id"), F.concat(F.lit("loc-"), (key(F.col("locality_id")) - 1).cast("string")).alias("current_id"))
    pairs = pairs.join(known, pairs.current_id == known.locality_id, "left_semi")
    merged = resolve.merge_localities(current, historic, pairs)
    return merged.select("locality_id", "arabic", "district", "slug", F.size("population").alias("n_population"), F.array_join("evidence.source_id", ",").alias("cited"), F.col("refs")["wiki"].alias("wiki"), F.col("historic_point").isNotNull().alias("moved"))


@query("""WITH RECURSIVE keyed AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || CAST(p_size AS VARCHAR)), '[^a-z0-9]+', '-', 'g'), '-')
    || CASE WHEN p_partkey % 23 = 0 THEN '-2-2' WHEN p_partkey % 11 = 0 THEN '-2' ELSE '' END AS s FROM part),
  stems AS (SELECT p_partkey, regexp_replace(s, '(-2)+$', '') AS stem, s FROM keyed),
  family AS (SELECT *, (length(s) - length(stem)) // 2 AS own, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) AS n FROM stems),
  walk AS (SELECT stem, n, p_partkey, own AS level, [own] AS taken FROM family WHERE n = 1
    UNION ALL SELECT stem, n, p_partkey, level, list_append(taken, level) FROM (
      SELECT f.stem, f.n, f.p_partkey, w.taken, list_min(list_filter(range(f.own, f.own + len(w.taken) + 1), lambda c: NOT list_contains(w.taken, c))) AS level FROM walk w JOIN family f ON f.stem = w.stem AND f.n = w.n + 1))
SELECT p_partkey, stem || repeat('-2', CAST(level AS INTEGER)) AS unique_id FROM walk""")
def unique_id_suffix(spark, d):
    """Some keys carry suffixes of their own, before or after plain ones."""
    k = F.col("p_partkey")
    own = F.when(k % 23 == 0, "-2-2").when(k % 11 == 0, "-2").otherwise("")
    slugged = F.concat(T.slug(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))), own)
    return resolve.unique_ids(table(spark, d, "part").select("p_partkey", slugged.alias("s")), "s", "p_partkey").select("p_partkey", "unique_id")


@query("""SELECT 'pom-' || h.c_custkey AS historic_id, 'loc-' || c.c_custkey AS current_id, 94.5 AS metres, FALSE AS wide FROM customer h JOIN customer c ON h.c_custkey = c.c_custkey + 1 WHERE c.c_custkey % 2 = 0""")
def reconciled_pairs(spark, d):
    """Places are found by position and by names of two spellings."""
    pairs = resolve.matched_pairs(_localities(spark, d, False), _localities(spark, d, True))
    return pairs.select("historic_id", "current_id", F.round("distance_m", 1).alias("metres"), "wide")


def _shared_localities(spark, d, historic: bool):
    """As ``_localities``, but every ninth place lies where its predecessor lies, under its name."""
    own = F.regexp_extract("locality_id", r"(\d+)$", 1).cast("long")
    place = F.floor(own / 2) - F.when(F.floor(own / 2) % 9 == 5, 1).otherwise(0)
    name = F.concat(F.lit("Beit " if not historic else "Bayt "), F.regexp_replace(F.conv(place.cast("string"), 10, 26), "[0-9]", "q"))
    return _localities(spark, d, historic).withColumns({"name": name, "x": (place % 300) * 0.1 + (0.001 if historic else 0.0), "y": (F.floor(place / 300) * 0.1).cast("double")})


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey // 2 AS place, c_custkey % 2 AS h FROM customer),
  spot AS (SELECT k, h, place, place - CASE WHEN place % 9 = 5 THEN 1 ELSE 0 END AS spot_id FROM p),
  cur AS (SELECT k, spot_id FROM spot WHERE h = 0),
  his AS (SELECT k, spot_id FROM spot WHERE h = 1),
  paired AS (SELECT his.k, (SELECT 'loc-' || min(cur.k) FROM cur WHERE cur.spot_id = his.spot_id) AS target FROM his),
  whole AS (SELECT 'loc-' || c.k AS id, c.spot_id, c.k AS ord, 0 AS part, (SELECT string_agg('his' || p.k, ',' ORDER BY p.k) FROM paired p WHERE p.target = 'loc-' || c.k) AS taken, 'cur' || c.k AS own FROM cur c
    UNION ALL SELECT 'pom-' || p.k, h.spot_id, p.k, 1, NULL, 'his' || p.k FROM paired p JOIN his h USING (k) WHERE p.target IS NULL),
  ranked AS (SELECT *, concat_ws(',', own, taken) AS cited, row_number() OVER (PARTITION BY spot_id, part ORDER BY ord) AS n FROM whole)
SELECT any_value(id) FILTER (WHERE n = 1) AS locality_id, string_agg(cited, ',' ORDER BY ord) AS cited, len(string_split(string_agg(cited, ',' ORDER BY ord), ',')) AS n_cited FROM ranked GROUP BY spot_id, part""")
def reconciled_localities(spark, d):
    """Pairs and records of one position become one record with all evidence, in source order."""
    current, historic = (
        t.withColumn("evidence", F.transform("evidence", lambda e: e.withField("source_id", F.concat(e["source_id"], F.regexp_extract("locality_id", r"(\d+)$", 1)))))
        for t in (_shared_localities(spark, d, False), _shared_localities(spark, d, True))
    )
    kept = build.reconcile(current, historic)["localities"]
    return kept.select("locality_id", F.array_join("evidence.source_id", ",").alias("cited"), F.size("evidence").cast("long").alias("n_cited"))


def _history(spark, d):
    status = F.create_map(*[F.lit(v) for p in (("P", 1), ("F", 2), ("O", 3)) for v in p])
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), status[F.col("o_orderstatus")].alias("stage"), F.to_date("o_orderdate").alias("valid_from"))


@query("""SELECT o_custkey AS entity_id, max(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 WHEN 'O' THEN 3 END) FILTER (WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-30') AS stage FROM orders GROUP BY 1""")
def stage_as_of(spark, d):
    return _history(spark, d).groupBy("entity_id").agg(aggregates.reached(F.col("stage"), F.col("valid_from"), F.lit(date(1997, 6, 30))).alias("stage"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN FALSE ELSE year(o_orderdate) <= 1998 END AS drops_undated,
  CASE WHEN o_orderkey % 3 = 0 THEN TRUE ELSE year(o_orderdate) <= 1998 END AS keeps_undated FROM orders""")
def stage_as_of_keep_undated(spark, d):
    day = F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", dates.as_of(day, 1998).alias("drops_undated"), dates.as_of(day, 1998, keep_undated=True).alias("keeps_undated"))


@query("""WITH cited AS (SELECT doc_id, source, lang FROM documents), ids AS (SELECT DISTINCT source, lang FROM cited)
SELECT source AS source_id, lang AS title, (SELECT count(*) FROM cited c WHERE c.source = i.source AND c.lang = i.lang) AS n_citing FROM ids i""")
def evidence_dictionary(spark, d):
    none = F.lit(None)
    e = F.struct(F.col("source").alias("source_id"), F.col("lang").alias("title"), F.lit("").alias("url"), none.cast("date").alias("document_date"), none.cast("date").alias("retrieved"), none.cast("string").alias("note"))
    rows, dictionary = provenance.hoist(table(spark, d, "documents").select("doc_id", F.array(e, e).alias("evidence")))
    used = rows.select(F.explode("evidence_ref").alias("evidence_id")).groupBy("evidence_id").agg(F.count("*").alias("n_citing"))
    return dictionary.join(used, "evidence_id").select("source_id", "title", "n_citing")


@query("""SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.lang = 'en')""")
def dangling_refs(spark, d):
    known = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("evidence_id"))
    rows = table(spark, d, "labels").select("doc_id", F.array(F.col("doc_id").cast("string")).alias("evidence_ref"))
    return provenance.dangling(rows, known, "doc_id").select("doc_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%')""")
def enabled_semi(spark, d):
    orders = table(spark, d, "orders").withColumn("source_id", F.col("o_orderpriority"))
    sources = orders.select("source_id").distinct().withColumn("enabled", F.substring("source_id", 1, 1).isin("1", "3"))
    return provenance.enabled_only(orders, sources).select("o_orderkey")


@query("""WITH t AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM t WHERE role <> 'system' GROUP BY conv_id""")
def resolve_refs_ordered(spark, d):
    refs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(refs.alias("evidence_ref"))
    known = spark.createDataFrame([("user",), ("assistant",)], "evidence_id string")
    found = provenance.resolve(rows, known, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))).alias("r"))
    return found.select("conv_id", F.array_join(F.transform("r", lambda e: e["evidence_id"]), ">").alias("roles"))


@query(f"""WITH {CUSTOMERS} SELECT count(*) AS total, count(*) FILTER (WHERE x <= 9) AS kept, count(*) FILTER (WHERE NOT x <= 9) AS withheld FROM points""")
def conservation_counts(spark, d):
    return aggregates.conserved(customer_points(spark, d), F.col("x") <= 9)


@query("""SELECT substr(sha256(string_agg(name || ':' || digest, ';' ORDER BY name)), 1, 12) AS build_id FROM (SELECT n_name AS name, sha256(n_name || '/' || CAST(n_regionkey AS VARCHAR)) AS digest FROM nation)""")
def content_fingerprint(spark, d):
    files = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.sha2(F.concat_ws("/", "n_name", F.col("n_regionkey").cast("string")), 256).alias("sha256"))
    return provenance.fingerprint(files)


@query("""SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey * 31, s_name FROM supplier WHERE s_suppkey * 31 NOT IN (SELECT c_custkey FROM customer)""")
def union_anti_append(spark, d):
    current = table(spark, d, "customer").select("c_custkey", "c_name")
    return resolve.append_missing(current, table(spark, d, "supplier").select((F.col("s_suppkey") * 31).alias("c_custkey"), F.col("s_name").alias("c_name")), "c_custkey")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 99 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id AS id FROM events""")
def map_merge_last_wins(spark, d):
    old = F.from_json("props", "map<string,string>")
    ident = F.col("event_id").cast("string")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("99"), F.lit("id"), ident)).otherwise(F.create_map(F.lit("id"), ident))
    merged = resolve.merged_maps(F.array(old), new)
    return table(spark, d, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].cast("bigint").alias("k"), F.col("m")["id"].cast("bigint").alias("id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN year(o_orderdate) >= 1997 AND o_orderdate <= TIMESTAMP '2000-01-01' THEN CAST(o_orderdate AS DATE) END AS day,
  o_orderkey % 4 = 0 OR NOT (year(o_orderdate) >= 1997 AND o_orderdate <= TIMESTAMP '2000-01-01') AS rejected FROM orders""")
def dirty_date(spark, d):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.lit("31/02/2025 x")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    day = dates.plausible_date(raw, date(2000, 1, 1), date(1997, 1, 1))
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), dates.rejected(raw, day).alias("rejected"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 1000 WHEN 1 THEN NULL ELSE p_size END AS value, CASE WHEN p_partkey % 3 = 1 THEN 'with ' || p_name END AS note FROM part""")
def dirty_number(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.format_number(k * 1000, 0)).when(k % 3 == 1, F.concat(F.lit("with "), "p_name")).otherwise(F.col("p_size").cast("string"))
    noted = values.number_or_note(raw)
    return table(spark, d, "part").select("p_partkey", F.coalesce(noted["value"], values.whole_number(raw)).alias("value"), F.when(k % 3 == 1, noted["note"]).alias("note"))
