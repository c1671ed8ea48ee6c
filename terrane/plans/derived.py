"""Geometry, dates and places derived from the driver's tables by plain arithmetic.

The tables hold no geometry, so keys become squares and points in the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.session import table


def _pick(v):
    return v.cast("double")


def nation_polygons(spark: SparkSession, d: str) -> DataFrame:
    """A square of side 2 for each nation; every seventh has a hole, some a second part."""
    k = F.col("n_nationkey")
    x0, y0 = _pick(k % 5) * 2.0, _pick(F.floor(k / 5)) * 2.0
    outer, hole = G.rectangle(x0, y0, x0 + 2, y0 + 2), G.rectangle(x0 + 0.5, y0 + 0.5, x0 + 1.5, y0 + 1.5)
    second = G.rectangle(x0 + 9, y0, x0 + 9.5, y0 + 0.5)
    parts = F.when(k % 7 == 0, F.array(F.array(outer, hole))).when(k % 7 == 3, F.array(F.array(outer), F.array(second))).otherwise(F.array(F.array(outer)))
    return table(spark, d, "nation").select(k.alias("fid"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), G.geometry("MultiPolygon", parts).alias("geom"))


def customer_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("pid"), F.col("c_nationkey").alias("declared"), F.col("c_mktsegment").alias("segment"),
        (_pick(k * 37 % 1200) / 100.0 + 0.003).alias("x"), (_pick(k * 91 % 1200) / 100.0 + 0.007).alias("y"),
    )


def supplier_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("sid"), F.col("s_nationkey").alias("declared"), (_pick(k * 53 % 1000) / 100.0 + 0.003).alias("x"), (_pick(k * 29 % 1000) / 100.0 + 0.007).alias("y")
    )


def part_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Dated boxes of 0.02 to 0.1 degrees, one for each part."""
    k = F.col("p_partkey")
    x0, y0, side = _pick(k * 17 % 97) / 100.0, _pick(k * 31 % 89) / 100.0, 0.02 + _pick(k % 5) * 0.02
    dated = F.when(k % 4 == 0, None).otherwise(F.date_add(F.lit("1970-01-01").cast("date"), (k * 101 % 18000).cast("int")))
    return table(spark, d, "part").select(k.alias("fid"), (k % 3).alias("layer"), dated.alias("dated"), G.geometry("Polygon", F.array(F.array(G.rectangle(x0, y0, x0 + side, y0 + side)))).alias("geom"))


#: The same in SQL.
NATIONS = """nations AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, CAST(n_nationkey % 5 AS DOUBLE) * 2 AS x0,
  CAST(n_nationkey // 5 AS DOUBLE) * 2 AS y0 FROM nation)"""
CUSTOMERS = """points AS (SELECT c_custkey AS pid, c_nationkey AS declared, c_mktsegment AS segment,
  CAST(c_custkey * 37 % 1200 AS DOUBLE) / 100 + CAST(0.003 AS DOUBLE) AS x, CAST(c_custkey * 91 % 1200 AS DOUBLE) / 100 + CAST(0.007 AS DOUBLE) AS y FROM customer)"""
SUPPLIERS = """suppliers AS (SELECT s_suppkey AS sid, s_nationkey AS declared,
  CAST(s_suppkey * 53 % 1000 AS DOUBLE) / 100 + CAST(0.003 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 1000 AS DOUBLE) / 100 + CAST(0.007 AS DOUBLE) AS y FROM supplier)"""
INSIDE = """((x > x0 AND x < x0 + 2 AND y > y0 AND y < y0 + 2
    AND NOT (k % 7 = 0 AND x > x0 + 0.5 AND x < x0 + 1.5 AND y > y0 + 0.5 AND y < y0 + 1.5))
  OR (k % 7 = 3 AND x > x0 + 9 AND x < x0 + 9.5 AND y > y0 AND y < y0 + 0.5))"""
RECTANGLES = """rects AS (SELECT p_partkey AS fid, p_partkey % 3 AS layer, CAST(p_partkey * 17 % 97 AS DOUBLE) / 100 AS x0,
  CAST(p_partkey * 31 % 89 AS DOUBLE) / 100 AS y0, CAST(0.02 AS DOUBLE) + CAST(p_partkey % 5 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS side,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE DATE '1970-01-01' + CAST(p_partkey * 101 % 18000 AS INTEGER) END AS dated FROM part)"""
