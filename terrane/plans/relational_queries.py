"""Queries of the relational operators over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import dates, values
from terrane.operators import aggregates, provenance
from terrane.plans.registry import query
from terrane.session import table


@query("""SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON c_nationkey = n_nationkey GROUP BY 1""")
def zero_kept_counts(spark, d):
    rows = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"))
    return aggregates.zero_kept_counts(rows, table(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS histogram FROM c GROUP BY 1""")
def histogram_desc(spark, d):
    out = aggregates.histogram(table(spark, d, "events"), "user_id", "event_type")
    return out.select("user_id", F.array_join(F.transform("histogram", lambda e: F.concat_ws("=", e["value"], e["n"].cast("string"))), ",").alias("histogram"))


_ROUNDS = """rounds AS (SELECT 'r1' AS round, CASE WHEN l_quantity > 25 THEN 1 END AS assessed, CAST(l_shipdate AS DATE) AS dated FROM lineitem
  UNION ALL SELECT 'r2', CASE WHEN l_discount > 0.05 THEN 2 END, date_trunc('month', l_shipdate)::DATE FROM lineitem
  UNION ALL SELECT 'r3', CASE WHEN l_tax > 0.04 THEN 3 END, DATE '2025-01-01' FROM lineitem)"""


def _wide(spark, d):
    ship = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_quantity") > 25, 1).alias("a1"), ship.alias("d1"), F.when(F.col("l_discount") > 0.05, 2).alias("a2"), F.trunc(ship, "month").alias("d2"),
        F.when(F.col("l_tax") > 0.04, 3).alias("a3"), F.lit("2025-01-01").cast("date").alias("d3"),
    )


_PAIRS = {"r1": ("a1", "d1"), "r2": ("a2", "d2"), "r3": ("a3", "d3")}


@query(f"WITH {_ROUNDS} SELECT round, assessed, count(*) AS n FROM rounds GROUP BY 1, 2")
def unpivot_rounds(spark, d):
    return aggregates.unpivot_rounds(_wide(spark, d), [], _PAIRS).groupBy("round", "assessed").agg(F.count("*").alias("n"))


@query(f"""WITH {_ROUNDS}, c AS (SELECT round, dated, count(*) AS n FROM rounds WHERE assessed IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY n DESC, dated) AS r, count(*) OVER (PARTITION BY round) > 1 AS mixed, sum(n) OVER (PARTITION BY round) AS total FROM c)
SELECT round, CAST(total AS BIGINT) AS n, dated, mixed FROM m WHERE r = 1""")
def mode_per_group(spark, d):
    return aggregates.round_summary(aggregates.unpivot_rounds(_wide(spark, d), [], _PAIRS))


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS total, round(sum(l_quantity) * 100 / (SELECT sum(l_quantity) FROM lineitem), 2) AS pct FROM lineitem GROUP BY 1""")
def area_shares(spark, d):
    return aggregates.shares(table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity")).withColumn("total", F.round("total", 2))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3""")
def topk_detail(spark, d):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return aggregates.top_rows(table(spark, d, "lineitem"), "l_suppkey", order, 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT user_id, event_id, before FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before > value""")
def monotone_falls(spark, d):
    return aggregates.falls(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "before")


@query("""SELECT n_regionkey, min(n_name) AS n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation WHERE n_nationkey % 3 <> 0) WHERE r = 1 GROUP BY 1""")
def first_present(spark, d):
    rows = table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.lit(" ")).otherwise(F.col("n_name")))
    return aggregates.first_present(rows, "n_regionkey", "n_name", "n_nationkey")


@query("""SELECT event_type, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, count(*) FILTER (WHERE value > 50) AS n_large FROM events GROUP BY 1""")
def date_span_per_group(spark, d):
    rows = table(spark, d, "events").groupBy("event_type")
    return rows.agg(F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"), F.count_if(F.col("value") > 50).alias("n_large"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 2.0 WHEN o_totalprice >= 200000 THEN 20.0 WHEN o_totalprice < 50000 THEN 2 + (o_totalprice - 1000) * 8 / 49000 ELSE 10 + (o_totalprice - 50000) * 10 / 150000 END AS radius_raw,
  (o_totalprice >= 1000)::INT + (o_totalprice >= 50000)::INT + (o_totalprice >= 200000)::INT AS bucket FROM orders""".replace("AS radius_raw", "AS radius").replace("SELECT o_orderkey, CASE", "SELECT o_orderkey, round(CASE").replace("END AS radius", "END, 4) AS radius"))
def ramp_buckets(spark, d):
    price = F.col("o_totalprice")
    ramp = values.ramp(price, [(1000, 2), (50000, 10), (200000, 20)])
    return table(spark, d, "orders").select("o_orderkey", F.round(ramp, 4).alias("radius"), values.bucket(price, [1000, 50000, 200000]).alias("bucket"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END, CAST(o_orderdate AS DATE) + 7) AS day FROM orders""")
def feature_dates(spark, d):
    own = F.to_date("o_orderdate")
    history = F.array(F.struct(F.date_add(own, 9).alias("valid_from")), F.struct(F.date_add(own, 7).alias("valid_from")))
    return table(spark, d, "orders").select("o_orderkey", dates.feature_date(F.when(F.col("o_orderkey") % 2 == 0, own), history=history).alias("day"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN date_trunc('year', o_orderdate)::DATE WHEN 2 THEN make_date(2023, 2, 1) END AS day FROM orders""")
def listing_dates(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(day, "dd، MMM yyyy")).when(k % 4 == 1, F.concat(F.lit("late "), F.date_format(day, "yyyy"))).when(k % 4 == 2, F.lit("31, Feb 2023"))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_listing_date(raw).alias("day"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN FALSE WHEN c_custkey % 11 = 0 THEN FALSE ELSE TRUE END AS usable,
  CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS part, CAST(c_custkey % 2 = 0 AS INTEGER) AS even FROM customer""")
def coordinate_checks(spark, d):
    k = F.col("c_custkey")
    lon = F.when(k % 10 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(-1.7976931348623157e308)).otherwise(F.lit(35.0))
    return table(spark, d, "customer").select("c_custkey", values.usable_coordinates(lon, F.lit(31.0)).alias("usable"), values.within_total(F.col("c_acctbal"), F.lit(5000.0)).alias("part"), (k % 2 == 0).cast("int").alias("even"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def first_seen_dedupe(spark, d):
    """The first entry of each key, by time and place."""
    rows = table(spark, d, "lineitem").withColumn("at", F.struct("l_shipdate", "l_linenumber"))
    return provenance.first_by(rows, "l_orderkey", "at").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))


@query("""SELECT c.c_mktsegment AS segment, n.n_regionkey AS region, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2""")
def star_rollup(spark, d):
    """Dates reach the scan as pushed filters and small dimensions are broadcast by their size."""
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
