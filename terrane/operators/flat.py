"""Client rows: entities, localities and incidents as flat columns, and what a client derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geometry as G

ENTITY = ("entity_id", "type", "name", "names", "district", "retroactive_authorisation_date", "stage_history", "population", "evidence")
LOCALITY = (
    "locality_id", "name", "names", "district", "subdistrict", "pop_1945_total", "pop_1945_palestinian", "in_east_jerusalem", "oslo_area", "population", "depopulated_1948", "depopulated_date",
    "status_now", "group_1945", "group_now", "mechanism", "historic_point", "oral_history_count", "refs", "evidence",
)
INCIDENT = ("incident_id", "title", "date", "url", "source_id", "record_type", "summary", "categories", "location_text", "matched_locality_id", "matched_from", "confidence", "match_note")


def _named(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The columns in their order; those that the rows lack are null."""
    return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])


def _names(rows: DataFrame) -> DataFrame:
    have = [n for n in ("arabic", "hebrew", "transliterations") if n in rows.columns]
    return rows.withColumn("names", F.struct(F.col("name").alias("primary"), *have)) if "names" not in rows.columns else rows


def entity_rows(entities: DataFrame) -> DataFrame:
    return _named(_names(entities), ENTITY)


def figure(population: Column, year: int, group: str | None) -> Column:
    """The first figure of a year, of the whole (no group) or of one group; zero and missing ones don't count."""
    of = lambda e: (F.coalesce(e["grp"], F.lit("")) == "") if group is None else (e["grp"] == group)
    found = F.filter(population, lambda e: (e["year"] == year) & of(e) & (e["value"] != 0))
    return F.get(found, F.lit(0))["value"]


def locality_rows(localities: DataFrame) -> DataFrame:
    """Flat localities with the figures that symbols are sized by; the number of interviews is null when there are none."""
    rows = _names(localities).withColumns({"pop_1945_total": figure(F.col("population"), 1945, None), "pop_1945_palestinian": figure(F.col("population"), 1945, "Palestinian")})
    count = F.nullif(F.size("oral_histories"), F.lit(0)) if "oral_histories" in rows.columns else F.lit(None).cast("int")
    return _named(rows.withColumn("oral_history_count", count), LOCALITY)


def incident_rows(incidents: DataFrame) -> DataFrame:
    return _named(incidents, INCIDENT)


def symbol_size(rows: DataFrame) -> Column:
    """The group's figure, else the total, else zero."""
    return F.coalesce(F.col("pop_1945_palestinian"), F.col("pop_1945_total"), F.lit(0))


def label(name: Column, arabic: Column) -> Column:
    """The name, with the Arabic one below it where there is one."""
    return F.when(F.nullif(F.trim(arabic), F.lit("")).isNotNull(), F.concat_ws("\n", name, arabic)).otherwise(name)


def first_year(rows: DataFrame, day: str = "valid_from", history: str = "stage_history") -> DataFrame:
    """The earliest year of any stage; one row, null without dated stages."""
    return rows.select(F.explode_outer(F.transform(history, lambda e: F.year(e[day]))).alias("y")).agg(F.min("y").alias("first_year"))


def relative_to_last(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each value of a series as a share of its last one (null when that is zero)."""
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("share", F.try_divide(F.col(value), F.last(value).over(whole)))


def zipped(names: list[str], *columns: Column) -> Column:
    """Parallel lists as one list of structs, by place."""
    return F.arrays_zip(*[c.alias(n) for n, c in zip(names, columns)])


def layer_box(features: DataFrame, default: tuple[float, float, float, float], geom: str = "geom") -> DataFrame:
    """``x0, y0, x1, y1`` round all vertices of a layer, or the default for a layer without any."""
    boxes = features.select(G.bounds(F.col(f"{geom}.parts")).alias("b"))
    found = {n: f(f"b.{n}") for n, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))}
    return boxes.agg(*[F.coalesce(c, F.lit(float(d))).alias(n) for (n, c), d in zip(found.items(), default)])


def point_of(geom: Column) -> Column:
    """The first vertex of a geometry: the position of a point."""
    return F.get(F.get(F.get(geom["parts"], F.lit(0)), F.lit(0)), F.lit(0))
