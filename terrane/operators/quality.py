"""Data invariants as queries that must return no rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import provenance, spatial


def uncited(features: DataFrame, key: str) -> DataFrame:
    return features.where("evidence_ref is null or size(evidence_ref) = 0").select(key)


def incomplete_evidence(table: DataFrame) -> DataFrame:
    return table.where("coalesce(trim(source_id), '') = '' or coalesce(trim(title), '') = ''")


def guessed_locations(incidents: DataFrame) -> DataFrame:
    """Placed without an exact or matched confidence, or periodic."""
    return incidents.where("matched_locality_id is not null and (confidence not in ('exact', 'matched') or record_type <> 'field_story')")


def shared_positions(localities: DataFrame) -> DataFrame:
    return localities.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")


def contradictions(localities: DataFrame) -> DataFrame:
    """Depopulated and present at once."""
    return localities.where("depopulated_1948 and coalesce(present_now, false)")


def far_history(localities: DataFrame, most_m: float = 2600.0) -> DataFrame:
    moved = G.metres(F.col("x"), F.col("y"), F.col("historic_point.x"), F.col("historic_point.y"))
    return localities.where(F.col("historic_point").isNotNull() & (moved > most_m))


def not_a_union(subsets: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Unions smaller than a part or larger than the sum of parts."""
    parts = subsets.where("not contains(subset_key, '+')").select(F.col("subset_key").alias("part"), F.col("km2").alias("part_km2"))
    held = subsets.select("subset_key", "km2", F.explode(F.split("subset_key", "\\+")).alias("part")).join(parts, "part")
    bounds = held.groupBy("subset_key", "km2").agg(F.max("part_km2").alias("low"), F.sum("part_km2").alias("high"))
    return bounds.where((F.col("km2") < F.col("low") - tolerance) | (F.col("km2") > F.col("high") + tolerance))


def invented_names(entities: DataFrame, pattern: str = r"^Unidentified \w+ \(.+\)$") -> DataFrame:
    return entities.where(F.col("name").startswith("Unidentified") & ~F.col("name").rlike(pattern))


def undated_stages(history: DataFrame, highest: int = 6) -> DataFrame:
    return history.where((F.col("valid_from").isNull()) | (F.col("stage") > highest) | (F.col("stage") < 1))


def wrong_mechanism_dates(localities: DataFrame) -> DataFrame:
    return localities.where("depopulated_1948 and depopulated_date is not null and not (year(to_date(substring(depopulated_date, 1, 4))) between 1947 and 1950)")


def parts_over_total(population: DataFrame) -> DataFrame:
    return population.where("part_value > total_value")


def missing_extents(layers: DataFrame, vocabulary: DataFrame, key: str = "extent_type") -> DataFrame:
    """Extent types that were not written, or without a definition; empty layers count as written."""
    return vocabulary.join(layers.where("definition is not null"), key, "left_anti")


def out_of_range(features: DataFrame, west: float, south: float, east: float, north: float, geom: str = "geom") -> DataFrame:
    b = features.withColumn("_b", G.bounds(F.col(f"{geom}.parts")))
    return b.where((F.col("_b.x0") < west) | (F.col("_b.y0") < south) | (F.col("_b.x1") > east) | (F.col("_b.y1") > north)).drop("_b")


def open_rings(features: DataFrame, geom: str = "geom") -> DataFrame:
    return features.where(F.col(f"{geom}.kind").contains("Polygon") & ~G.closed_rings(F.col(f"{geom}.parts")))


def unknown_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return provenance.unregistered(rows, sources)


def missing_attributions(sources: DataFrame) -> DataFrame:
    return sources.where("enabled and coalesce(trim(attribution), '') = ''")


def unknown_licences(sources: DataFrame, known: list[str]) -> DataFrame:
    return sources.where(F.col("enabled") & ~F.coalesce(F.col("licence").isin(*known), F.lit(False)))


def share_out_of_band(shares: DataFrame, key: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    wrong = F.lit(False)
    for member, (centre, width) in bands.items():
        wrong = wrong | ((F.col(key) == member) & (F.abs(F.col("pct") - centre) > width))
    return shares.where(wrong)


def points_outside(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    return spatial.outside(points, polygons, key)


def blank_strings(rows: DataFrame, columns: list[str]) -> DataFrame:
    blank = F.lit(False)
    for c in columns:
        blank = blank | F.coalesce(F.trim(c) == "", F.lit(False))
    return rows.where(blank)


def unusable_facilities(facilities: DataFrame) -> DataFrame:
    from terrane.functions.values import usable_coordinates

    return facilities.where(~usable_coordinates(F.col("x"), F.col("y")))


def not_conserved(counters: DataFrame) -> DataFrame:
    return counters.where("total <> kept + withheld")


def uncited_claims(claims: DataFrame, table: DataFrame) -> DataFrame:
    return provenance.dangling(claims, table, "claim_id")


def future_dates(rows: DataFrame, column: str, as_of: date) -> DataFrame:
    return rows.where(F.col(column) > F.lit(as_of))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """``invariant, violations`` for each named check."""
    out = None
    for name, rows in sorted(checks.items()):
        counted = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations")
        out = counted if out is None else out.unionByName(counted)
    return out
