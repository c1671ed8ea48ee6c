"""Containment joins with an explicit policy for zero, one and several matches.

Polygons are covered by cells of three sizes (``cover``): inner ones need no test, edge ones carry only the edges
that count there. Points have one cell of each size, and the join is an equi-join on cells with the exact test
as residual. Spark picks the strategy: a small cover is broadcast, a large one is shuffled by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import cover

CELL = 0.5


def _grid(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(cell)).cast("int")


def matches(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", geom: str = "geom", cell: float = CELL) -> DataFrame:
    """All pairs of a point and a polygon that holds it, without the geometry; unusable points have none."""
    cells = cover.polygon_cells(polygons, geom, cell)
    usable = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    places = [F.struct(F.lit(k).alias("_level"), _grid(F.col(x), size).alias("_cx"), _grid(F.col(y), size).alias("_cy")) for k, size in enumerate(cover.sizes(cell))]
    keyed = usable.withColumn("_place", F.explode(F.array(*places))).select("*", "_place.*").drop("_place")
    near = keyed.join(cells, ["_level", "_cx", "_cy"])
    return near.where(F.col("_edges").isNull() | cover.holds(F.col("_edges"), F.col(x), F.col(y))).drop("_level", "_cx", "_cy", "_edges")


def first_match(points: DataFrame, polygons: DataFrame, key: str, value: str, order: str, fallback: Column | None = None, **names) -> DataFrame:
    """Each point with the value of the first polygon (by ``order``) that holds it, else the fallback."""
    found = matches(points.select(key, names.get("x", "x"), names.get("y", "y")), polygons, **names)
    first = found.groupBy(key).agg(F.min_by(value, order).alias("_found"))
    out = points.join(first, key, "left")
    return out.withColumn(value, F.coalesce("_found", fallback if fallback is not None else F.lit(None))).drop("_found")


def exactly_one(polygons: DataFrame, points: DataFrame, key: str, name: str, **names) -> DataFrame:
    """Polygons named by the points inside: the name if there is just one, and how many there were."""
    found = matches(points.select(name, names.get("x", "x"), names.get("y", "y")), polygons, **names).groupBy(key)
    counted = found.agg(F.count_distinct(name).cast("int").alias("_n"), F.min(name).alias("_one"))
    out = polygons.join(counted, key, "left").withColumn("n_names", F.coalesce("_n", F.lit(0)))
    return out.withColumn("given_name", F.when(F.col("n_names") == 1, F.col("_one"))).drop("_n", "_one")


def counts(points: DataFrame, polygons: DataFrame, point_key: str, key: str, order: str, label: str | None = None, polygon_label: str | None = None, **names) -> DataFrame:
    """Points for each polygon, the first polygon taking a point; empty polygons stay with zero.

    With labels, also how many were labelled and how many labels agree with the polygon's.
    """
    from terrane.functions.text import contains_either_way

    chosen = [c for c in (point_key, label, names.get("x", "x"), names.get("y", "y")) if c]
    keep = F.struct(key, *([polygon_label] if polygon_label else []))
    found = matches(points.select(*chosen), polygons, **names)
    one = found.groupBy(point_key, *([label] if label else [])).agg(F.min_by(keep, order).alias("_in")).select("*", F.col(f"_in.{key}").alias(key))
    measures = [F.count("*").alias("_n")]
    if label and polygon_label:
        measures += [F.count_if(F.trim(label) != "").alias("_labelled"), F.count_if(contains_either_way(F.col(label), F.col(f"_in.{polygon_label}"))).alias("_agree")]
    grouped = one.groupBy(key).agg(*measures)
    out = polygons.join(grouped, key, "left").withColumn("n_points", F.coalesce("_n", F.lit(0))).drop("_n")
    if label and polygon_label:
        out = out.withColumn("labelled", F.coalesce("_labelled", F.lit(0))).withColumn("agreeing", F.coalesce("_agree", F.lit(0))).drop("_labelled", "_agree")
    return out


def outside(points: DataFrame, polygons: DataFrame, key: str, **names) -> DataFrame:
    """Points that no polygon holds, the unusable included."""
    inside = matches(points.select(key, names.get("x", "x"), names.get("y", "y")), polygons, **names).select(key).distinct()
    return points.join(inside, key, "left_anti")


def verify_anchors(claims: DataFrame, polygons: DataFrame, key: str, x: str = "x", y: str = "y", geom: str = "geom") -> DataFrame:
    """Claims by key, applied only where the named polygon holds the anchor; ``outcome`` tells."""
    joined = claims.join(polygons.select(key, geom), key, "left")
    inside = G.contains(F.col(f"{geom}.parts"), F.col(x), F.col(y))
    outcome = F.when(F.col(geom).isNull(), "unknown").when(inside, "applied").otherwise("refused")
    return joined.withColumn("outcome", outcome).drop(geom)


def holders_or_raise(anchors: DataFrame, polygons: DataFrame, anchor: str, key: str, **names) -> DataFrame:
    """The one polygon that holds each anchor; the query fails rather than guess among none or several."""
    found = matches(anchors, polygons, **names)
    counted = anchors.select(anchor).join(found.groupBy(anchor).agg(F.count("*").alias("n"), F.min(key).alias(key)), anchor, "left")
    wrong = F.concat(F.lit("anchor "), F.col(anchor).cast("string"), F.lit(" lies in "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" polygons"))
    return counted.select(anchor, F.when(F.col("n") == 1, F.col(key)).otherwise(F.raise_error(wrong).cast(polygons.schema[key].dataType)).alias(key))


def relabel(features: DataFrame, anchors: DataFrame, anchor: str, key: str, label: str, shared: str, right: str, note: str) -> DataFrame:
    """Features that share a label by mistake: the one that holds every anchor keeps it, the others get ``right``.

    The query fails rather than guess when the anchors don't all lie in one feature. Labels that only
    one feature has stay. ``class_corrected`` says why a label changed.
    """
    candidates = features.where(F.col(label) == shared)
    n = F.broadcast(candidates.agg(F.count("*").alias("_candidates")))  # one row
    asked = anchors.join(n, F.lit(True)).where("_candidates > 1").drop("_candidates")  # a label of one feature is no question
    held = holders_or_raise(asked, candidates, anchor, key).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    joined = features.join(n, F.lit(True), "left").join(F.broadcast(held), F.lit(True), "left")
    doubtful = (F.col(label) == shared) & (F.col("_candidates") > 1)
    split = F.raise_error(F.lit("the anchors lie in different polygons: no label is changed")).cast("boolean")
    moved = F.when(doubtful, F.when(F.col("_first").eqNullSafe(F.col("_last")), F.col(key) != F.col("_first")).otherwise(split)).otherwise(F.lit(False))
    joined = joined.withColumn("_moved", moved)
    return joined.select(*[F.when(F.col("_moved"), F.lit(right)).otherwise(F.col(c)).alias(c) if c == label else F.col(c) for c in features.columns], F.when(F.col("_moved"), F.lit(note)).alias("class_corrected"))


def topmost(points: DataFrame, polygons: DataFrame, key: str, value: str, layer_order: str, **names) -> DataFrame:
    """What a click hits: the polygon of the first layer in drawing order."""
    found = matches(points, polygons, **names)
    return found.groupBy(key).agg(F.min_by(value, layer_order).alias(value))


def assembled(records: DataFrame, group: str, geom: str = "geom", order: str = "ord") -> DataFrame:
    """One multipart geometry for each group, parts in source order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(f"{geom}.parts").alias("parts"))))
    grouped = records.groupBy(group).agg(parts.alias("_rows"), F.min(order).alias(order))
    return grouped.select(group, order, G.geometry("MultiPolygon", F.flatten(F.transform("_rows", lambda r: r["parts"]))).alias(geom))
