"""Explainers: prose whose every claim cites evidence, and what must hold of them.

An explainer has ``id``, ``title``, ``claims`` (a list of structs with ``text`` and ``evidence``, perhaps more) and ``unverified``
(a list of texts that are shown as open questions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import provenance


def published(explainers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explainers with references in place of evidence, and the dictionary of what they cite."""
    return provenance.hoist_nested(explainers)


def claims(hoisted: DataFrame) -> DataFrame:
    """One row for each claim: ``id, place, claim_id, text, evidence_ref``."""
    each = hoisted.select("id", F.posexplode("claims").alias("place", "c"))
    return each.select("id", "place", F.concat_ws(":", F.col("id").cast("string"), "place").alias("claim_id"), "c.text", "c.evidence_ref")


def without_claims(hoisted: DataFrame) -> DataFrame:
    return hoisted.where(F.coalesce(F.size("claims"), F.lit(0)) < 1).select("id")


def uncited(hoisted: DataFrame) -> DataFrame:
    """Claims without a reference."""
    return claims(hoisted).where(F.coalesce(F.size("evidence_ref"), F.lit(0)) < 1)


def dangling(hoisted: DataFrame, table: DataFrame) -> DataFrame:
    """References of claims that the dictionary doesn't know."""
    return provenance.dangling(claims(hoisted), table, "claim_id")


def undated(hoisted: DataFrame, table: DataFrame) -> DataFrame:
    """Citations of claims without the document's date or the date it was read."""
    used = claims(hoisted).select("claim_id", F.explode("evidence_ref").alias("evidence_id"))
    return used.join(table.where("document_date is null or retrieved is null"), "evidence_id", "left_semi")


def asserted_and_disclaimed(hoisted: DataFrame) -> DataFrame:
    """Open questions whose first sentence also stands among the claims of their explainer."""
    said = F.lower(F.array_join(F.transform("claims", lambda c: c["text"]), " "))
    open_ = hoisted.select("id", said.alias("_said"), F.explode("unverified").alias("question"))
    head = F.lower(F.element_at(F.split("question", "\\."), 1))
    return open_.where(F.contains("_said", head)).select("id", "question")
