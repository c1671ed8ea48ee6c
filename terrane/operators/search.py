"""Cross-script name search: an index of normalised keys and a ranked lookup."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.config import SETTINGS
from terrane.functions import text as T
from terrane.operators import ordered

SEPARATOR = " | "
MIN_QUERY, LIMIT = 2, 25


def keys(*names: Column, variants: Column | None = None) -> Column:
    """All keys of an entry's names, each once, in one string."""
    lists = [T.search_keys(n) for n in names]
    if variants is not None:
        lists.append(F.flatten(F.transform(F.coalesce(variants, F.array().cast("array<string>")), T.search_keys)))
    return F.array_join(F.array_distinct(F.flatten(F.array(*lists))), SEPARATOR)


def entries(rows: DataFrame, kind: Column) -> DataFrame:
    """``id, ord, display, keys, x, y, kind, arabic, hebrew, district, depopulated`` of named places."""
    have = rows.columns
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return rows.select(
        F.col("id"), F.col("ord"), F.col("name").alias("display"),
        keys(F.col("name"), text("arabic"), text("hebrew"), variants=F.col("transliterations") if "transliterations" in have else None).alias("keys"),
        F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), kind.alias("kind"), text("arabic").alias("arabic"), text("hebrew").alias("hebrew"),
        text("district").alias("district"), (F.coalesce(F.col("depopulated_1948"), F.lit(False)) if "depopulated_1948" in have else F.lit(False)).alias("depopulated"),
    )


def distinct_settlements(entities: DataFrame, settings=SETTINGS, parts: int | None = None) -> DataFrame:
    """Entities in order, without those near the last one kept of the same folded name (within the wide radius).

    An entity that went hides none after it. Those without a place aren't entries; of a repeated id the first row
    counts; unidentified ones aren't searchable and go. Only entities are folded among themselves, never
    with localities of the same name.
    """
    per, across, radius = settings.metres_per_degree, math.cos(math.radians(settings.reference_latitude)), settings.wide_radius_m
    there = entities.where("x is not null and y is not null")
    first = there.groupBy("id").agg(F.min("ord").alias("ord"))
    named = there.join(first, ["id", "ord"]).where(~F.col("name").startswith("Unidentified"))
    named = named.withColumn("_key", T.fold_transliteration(T.normalise(F.col("name"))))

    def far(ax: float, ay: float, bx: float, by: float) -> bool:
        return math.hypot((ax - bx) * (across * per), (ay - by) * per) > radius

    return ordered.last_kept(named, "_key", ["ord", "id"], "x", "y", far, parts).drop("_key")


def build(localities: DataFrame, entities: DataFrame) -> DataFrame:
    """The index: localities first, then settlements and other entities."""
    first = entries(localities, F.lit("locality"))
    second = entries(distinct_settlements(entities), F.col("type") if "type" in entities.columns else F.lit("settlement"))
    return first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))


def search(index: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Entries whose keys hold the query: hits at a word's start first, then in index order.

    The first place in the keys decides whether it is at a word's start. Queries of fewer than two
    characters find nothing.
    """
    wanted = T.normalise_query(F.lit(query))
    rows = index.withColumn("_q", wanted).where(F.length("_q") >= MIN_QUERY)
    at = F.call_function("instr", F.col("keys"), F.col("_q"))
    rows = rows.withColumn("_at", at).where("_at > 0")
    starts = (F.col("_at") == 1) | F.substr(F.col("keys"), F.col("_at") - 1, F.lit(1)).isin(" ", "|")
    rows = rows.withColumn("starts_word", starts)
    order = [F.col("starts_word").desc(), *([F.col("part")] if "part" in index.columns else []), F.col("ord"), F.col("id")]
    return rows.drop("_q", "_at").orderBy(*order).limit(limit)


def by_id(layers: list[DataFrame], ident: str, columns: list[str]) -> DataFrame:
    """The feature of an id from the first layer, in the order given, that has it."""
    found = None
    for k, layer in enumerate(layers):
        part = layer.where(F.col("id") == ident).select("id", *columns, F.lit(k).alias("layer"))
        found = part if found is None else found.unionByName(part)
    return found.orderBy("layer").limit(1)
