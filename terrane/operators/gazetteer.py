"""Text geocoding: the longest known phrase in a text, and confidence tiers for what it shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.config import SETTINGS
from terrane.functions import text as T

# Phrases up to which a list of them is broadcast.
BROADCAST_PHRASES = 100_000


def index(localities: DataFrame, settings=SETTINGS, guarded: bool = True) -> DataFrame:
    """``norm, locality_id``: normalised variants; with ``guarded`` no short or generic ones."""
    variants = F.concat(T.name_variants(F.col("name"), F.col("arabic")), F.coalesce(F.col("transliterations"), F.array().cast("array<string>")))
    rows = localities.select("locality_id", F.explode(variants).alias("v")).select("locality_id", T.normalise(F.col("v")).alias("norm")).where("norm <> ''").distinct()
    if guarded:
        rows = rows.where((F.length("norm") >= settings.min_name_length) & ~F.col("norm").isin(*settings.stop_names))
    return rows


def longest_phrases(texts: DataFrame, phrases: DataFrame, key: str, text: str, norm: str = "norm", already_normal: bool = False, max_words: int | None = None) -> DataFrame:
    """The longest phrases, ties kept, that stand in each text as whole words: ``key, norm``.

    Texts become their word n-grams up to the longest phrase and meet phrases by equality, so
    the join is keyed whatever the size of either side. Spark takes n-grams to be as small as their texts, so they
    must never be what is broadcast: a few phrases are, many meet them in a sorted join.
    """
    if max_words is None:
        max_words = phrases.agg(F.max(F.size(F.split(norm, " ")))).first()[0] or 1
    known = phrases.select(F.col(norm).alias("norm")).distinct()
    few = known.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES
    known = F.broadcast(known) if few else known.hint("merge")
    words = F.split(F.col(text) if already_normal else T.normalise(F.col(text)), " ")
    rows = texts.select(key, words.alias("_w")).where(F.size("_w") > 0)
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("_w"))),
            lambda n: F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " ")),
        )
    )
    hits = rows.select(key, F.explode(F.array_distinct(grams)).alias("norm")).join(known, "norm")
    best = Window.partitionBy(key).orderBy(F.length("norm").desc())
    return hits.withColumn("_r", F.rank().over(best)).where("_r = 1").select(key, "norm")


def exact(names: DataFrame, gazetteer: DataFrame, key: str, name: str) -> DataFrame:
    """Whole names that are one locality's variant and no other's; others stay with a null id and a count."""
    found = names.select(key, T.normalise(F.col(name)).alias("norm")).join(gazetteer, "norm").groupBy(key)
    counted = found.agg(F.countDistinct("locality_id").alias("n_candidates"), F.min("locality_id").alias("_one"))
    out = names.join(counted, key, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    return out.withColumn("locality_id", F.when(F.col("n_candidates") == 1, F.col("_one"))).drop("_one")


def _resolved(texts: DataFrame, gazetteer: DataFrame, text: str, max_words: int | None) -> DataFrame:
    hits = longest_phrases(texts, gazetteer, "incident_id", text, max_words=max_words).join(gazetteer, "norm")
    return hits.groupBy("incident_id").agg(F.array_sort(F.collect_set("locality_id")).alias("ids"), F.max("norm").alias("location_text"))  # ties of the longest


def incidents(records: DataFrame, gazetteer: DataFrame, localities: DataFrame, match_bodies: bool = True, max_words: int | None = None) -> DataFrame:
    """Records with ``location_text, matched_locality_id, matched_from, confidence, match_note``.

    The title decides; only field stories that it leaves open are searched by their body. One
    locality is matched, several are ambiguous, none is unresolved; periodic records always are.
    Records are withheld by tier, never dropped.
    """
    stories = records.where("record_type = 'field_story'")
    by_title = _resolved(stories, gazetteer, "title", max_words).withColumn("matched_from", F.lit("title"))
    found = by_title
    if match_bodies:
        rest = stories.join(by_title, "incident_id", "left_anti").where("body is not null and body <> ''")
        found = by_title.unionByName(_resolved(rest, gazetteer, "body", max_words).withColumn("matched_from", F.lit("body")))
    names = localities.select(F.col("locality_id").alias("_id"), "name")
    listed = found.select("incident_id", F.explode("ids").alias("_id")).join(names, "_id").groupBy("incident_id")
    listed = listed.agg(F.substring(F.array_join(F.array_sort(F.collect_set("name")), ", "), 1, 200).alias("_names"))
    out = records.join(found, "incident_id", "left").join(listed, "incident_id", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    periodic = F.col("record_type") != "field_story"
    confidence = F.when(periodic, "unresolved").when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unresolved")
    note = F.when(periodic, "periodic report: not one place").when(n > 1, F.concat(F.lit("could be: "), "_names")).when(n == 0, "no known place named")
    return out.withColumns({"confidence": confidence, "match_note": note, "matched_locality_id": F.when(n == 1, F.get("ids", F.lit(0)))}).drop("ids", "_names")


def renderable(found: DataFrame) -> DataFrame:
    """Field stories placed exactly or by a match, with a position."""
    return found.where("record_type = 'field_story' and confidence in ('exact', 'matched') and matched_locality_id is not null")
