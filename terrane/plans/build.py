"""The whole build as lazy tables: reconcile places, measure coverage, index names, resolve incidents.

Each function takes DataFrames and returns DataFrames; nothing runs until a table is written, but for what ``reconcile`` pins. What
cannot be resolved is a table of its own beside what can.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.config import CONFIDENCE_LEVELS, ENTITY_TYPES, MECHANISM_LABELS, SETTINGS, STAGE_LABELS, STAGES
from terrane.functions import geometry as G
from terrane.functions import text as T
from terrane.operators import coverage, explainers, gazetteer, ordered, provenance, quality, resolve, search, spatial
from terrane.sources import sinks, tables


def reconcile(current: DataFrame, historic: DataFrame, overrides: DataFrame | None = None, interviews: DataFrame | None = None, settings=SETTINGS) -> dict[str, DataFrame]:
    """One record for each place: ``localities``, ``withheld`` conflicts, ``pairs``, ``coincident`` and ``stats``.

    Records of one place at one position are merged like pairs are, in source order (current ones first).
    Pairs, merged records and judgements are read several times below, so each is made once, when this is called.
    """
    if interviews is not None:
        historic = tables.by_slug(historic, interviews).drop("oral_histories")
    pairs = ordered.checkpointed(resolve.matched_pairs(current, historic, settings))
    merged = ordered.checkpointed(resolve.merge_localities(current, historic, pairs))
    order = ("source_part", "ord", "locality_id")
    judged = ordered.checkpointed(resolve.coordinate_conflicts(merged, settings, order))
    kept = resolve.merge_coincident(judged, list(order)).drop("source_part")
    if overrides is not None:
        kept = resolve.apply_overrides(kept, overrides)
    withheld = judged.where("decision = 'withhold'").select("locality_id", "name", "x", "y", "survivor_id", "reason")
    coincident = judged.where("decision = 'merge'").select("survivor_id", "locality_id")
    counts = [
        current.agg(F.count("*").alias("current_records")), historic.agg(F.count("*").alias("historic_records")),
        pairs.agg(F.count_distinct("current_id").alias("merged_pairs"), F.count_if("wide").alias("wide_merges")),
        judged.agg(F.count_if(F.col("decision") == "keep").alias("output_localities"), F.count_if(F.col("decision") == "withhold").alias("withheld_coordinate_conflicts")),
        coincident.agg(F.count_distinct("survivor_id").alias("merged_on_shared_coordinates")),
    ]
    stats = counts[0]
    for one in counts[1:]:  # a row each
        stats = stats.crossJoin(one)
    return {"localities": kept, "withheld": withheld, "pairs": pairs, "coincident": coincident, "stats": stats}


def placed(localities: DataFrame, zones: DataFrame, zone: str, order: str, fallback: str | None = None) -> DataFrame:
    """Localities with the zone that holds them, else what their source says."""
    return spatial.first_match(localities, zones, "locality_id", zone, order, F.col(fallback) if fallback else None)


def land(layers: dict[str, DataFrame], extent: str, years: list[int] | None = None, cell_m: float = SETTINGS.coverage_cell_m) -> dict[str, DataFrame]:
    """Union areas of every subset of layers, and the same by the end of each year."""
    out = {"coverage": coverage.coverage(layers, extent, cell_m)}
    if years:
        out["timeline"] = coverage.timeline(layers, extent, years, cell_m=cell_m)
    return out


def land_total(subsets: DataFrame, chosen: list[str]) -> DataFrame:
    """The row of a selection of measures, in whatever order; no rows for none."""
    return subsets.where(F.col("subset_key") == coverage.subset_key(F.array(*[F.lit(c) for c in chosen]))) if chosen else subsets.where("false")


def measures(features: DataFrame, kind: str = "extent_type", whole_km2: float | None = None) -> DataFrame:
    """Area and number of features by kind, and the share of a whole."""
    summed = features.groupBy(kind).agg(F.round(F.sum("area_m2") / 1e6, 2).alias("km2"), F.count("*").alias("n"), F.sum(F.size("geom.parts")).alias("parts"))
    share = F.round(F.col("km2") * 100 / whole_km2, 2) if whole_km2 else F.lit(None).cast("double")
    return summed.withColumn("pct", share).orderBy(F.desc("km2"), kind)


def incidents(records: DataFrame, localities: DataFrame, match_bodies: bool = True) -> dict[str, DataFrame]:
    """Records by what their text names: ``rendered`` and ``withheld`` together are all of them."""
    named = gazetteer.incidents(records, gazetteer.index(localities), localities, match_bodies)
    positions = localities.select(F.col("locality_id").alias("matched_locality_id"), "x", "y")
    found = named.join(positions, "matched_locality_id", "left")
    shown = (F.col("record_type") == "field_story") & F.col("confidence").isin("exact", "matched") & F.col("x").isNotNull()
    return {"rendered": found.where(F.coalesce(shown, F.lit(False))), "withheld": found.where(~F.coalesce(shown, F.lit(False)))}


def destruction(records: DataFrame, localities: DataFrame, keywords: dict) -> dict[str, DataFrame]:
    """Violence records by locality: counts by kind and resource, first and last date; villages not placed stay apart."""
    from terrane.functions.dates import parse_day_first
    from terrane.operators.aggregates import histogram

    villages = records.select("village").distinct()
    named = gazetteer.exact(villages, gazetteer.index(localities, guarded=False), "village", "village")
    rows = records.join(named, "village", "left").withColumn("day", parse_day_first(F.col("date")))
    labels = T.categorise(F.concat_ws(" ", "violation_type", "property_damage_type"), keywords)
    rows = rows.withColumn("labels", labels)
    known = rows.where("locality_id is not null")
    base = known.groupBy("locality_id").agg(F.count("*").alias("record_count"), F.count_if(F.size("labels") == 0).alias("uncategorised"), F.min("day").alias("first_recorded"), F.max("day").alias("last_recorded"))
    kinds = histogram(known, "locality_id", "violation_type").withColumnRenamed("histogram", "violation_counts")
    resources = histogram(known.select("locality_id", F.explode("labels").alias("label")), "locality_id", "label").withColumnRenamed("histogram", "resource_counts")
    placed_ = base.join(kinds, "locality_id", "left").join(resources, "locality_id", "left")
    withheld = rows.where("locality_id is null").groupBy("village").agg(F.count("*").alias("records"), F.max("n_candidates").alias("n_candidates"))
    return {"placed": placed_, "withheld": withheld}


def extents(entities: DataFrame, definitions: DataFrame, tolerance: float = SETTINGS.context_tolerance_deg) -> dict[str, DataFrame]:
    """Published geometry by extent type: areas of the source geometry, then simplified lines; counts of vertices."""
    from terrane.functions.crs import area_m2

    measured = entities.withColumn("area_m2", area_m2(F.col("geom.parts")))
    thin = measured.withColumn("_thin", G.simplify(F.col("geom.parts"), tolerance))
    published = thin.withColumn("before", G.vertex_count(F.col("geom.parts"))).withColumn("after", G.vertex_count(F.col("_thin")))
    published = published.withColumn("geom", F.struct(F.col("geom.kind").alias("kind"), F.col("_thin").alias("parts"))).drop("_thin")
    counted = definitions.join(published.groupBy("extent_type").agg(F.count("*").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after")), "extent_type", "left")
    return {"features": published, "layers": counted.fillna(0, ["n", "before", "after"])}


def municipal(areas: DataFrame, named_points: DataFrame) -> DataFrame:
    """Municipal polygons with the one name that lies in them, else unnamed or ambiguous."""
    out = spatial.exactly_one(areas, named_points, "fid", "name")
    status = F.when(F.col("n_names") == 0, "unnamed").when(F.col("n_names") == 1, "named").otherwise("ambiguous")
    return out.withColumn("status", status)


def build_base(current: DataFrame, historic: DataFrame, entities: DataFrame, layers: dict[str, DataFrame], extent: str, definitions: DataFrame, overrides: DataFrame | None = None, years: list[int] | None = None, cell_m: float = SETTINGS.coverage_cell_m) -> dict[str, DataFrame]:
    """All tables that need no crawl."""
    out = reconcile(current, historic, overrides)
    out |= land(layers, extent, years, cell_m)
    out |= extents(entities, definitions)
    for name in ("localities", "coverage", "features"):  # several tables are made from each of these
        out[name] = out[name].persist()
    searchable = entities.withColumn("_c", G.ring_center(F.col("geom.parts"))).select(F.col("entity_id").alias("id"), "ord", "name", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), "type")
    out["search_index"] = search.build(out["localities"].withColumnRenamed("locality_id", "id"), searchable)
    out["hoisted"], out["evidence"] = provenance.hoist(out["localities"])
    return out


def build_all(base: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """The base tables with the incidents that name their localities, and the invariants' report."""
    out = dict(base)
    found = incidents(records, base["localities"])
    out["incidents"], out["incidents_unplaced"] = found["rendered"], found["withheld"]
    out["invariants"] = quality.report(
        {
            "cited rows resolve": provenance.dangling(base["hoisted"], base["evidence"], "locality_id"),
            "complete evidence": quality.incomplete_evidence(base["evidence"]),
            "no guessed places": quality.guessed_locations(found["rendered"]),
            "one place a position": quality.shared_positions(base["localities"]),
            "history is near": quality.far_history(base["localities"]),
            "unions are unions": quality.not_a_union(base["coverage"]),
            "rings are closed": quality.open_rings(base["features"]),
            "names are not invented": quality.invented_names(base["features"]),
        }
    )
    return out


def sidecars(tables_: dict[str, DataFrame], interviews: DataFrame | None = None, explainers_: DataFrame | None = None) -> dict[str, tuple[DataFrame, dict]]:
    """Records and header of each JSON sidecar that the tables give; citations of explainers are hoisted like every layer's.

    ``interviews`` has ``locality_id`` and the interview's columns, in ``ord``.
    """
    index = tables_["search_index"]
    scripts = index.agg(F.count("arabic").alias("arabic"), F.count("hebrew").alias("hebrew"), F.count("*").alias("n")).first()
    out = {
        "search_index": (index.orderBy("part", "ord", "id"), {"entries": scripts.n, "arabic": scripts.arabic, "hebrew": scripts.hebrew}),
        "locality_conflicts": (tables_["withheld"], {"note": "Withheld: each lies where a record of another name lies, so at least one position is wrong."}),
    }
    if "incidents_unplaced" in tables_:
        every = tables_["incidents"].unionByName(tables_["incidents_unplaced"])
        periodic = every.where("record_type = 'periodic_report'").select([c for c in ("title", "date", "url") if c in every.columns])
        out["documents"] = (periodic, {"note": "Periodic reports cover whole territories: they are listed and linked, never plotted."})
        out["incidents_unplaced"] = (tables_["incidents_unplaced"], {})
    if interviews is not None:
        own = [c for c in interviews.columns if c not in ("locality_id", "ord")]
        held = F.array_sort(F.collect_list(F.struct("ord", *own)))  # one locality's interviews
        listed = interviews.join(tables_["localities"].select("locality_id"), "locality_id", "left_semi").groupBy("locality_id").agg(held.alias("_h"))
        out["oral_histories"] = (listed.select("locality_id", F.transform("_h", lambda h: h.dropFields("ord")).alias("interviews")), {"note": "Metadata and links only."})
    if explainers_ is not None:
        hoisted, table = explainers.published(explainers_)
        out["explainers"] = (hoisted, {"claims": explainers.claims(hoisted).count()})
        out["evidence"] = (tables_["evidence"].unionByName(table.select(*tables_["evidence"].columns)).dropDuplicates(["evidence_id"]), {})
    elif "evidence" in tables_:
        out["evidence"] = (tables_["evidence"], {})
    return out


def metadata(tables_: dict[str, DataFrame], definitions: DataFrame, built: date, build_id: str) -> dict:
    """What the metadata document says: vocabularies, definitions and counts. Only closed vocabularies and counts are read."""
    counts = {r.name: r.rows for r in sinks.stats(tables_).collect()}
    return {
        "built": built.isoformat(), "build_id": build_id,
        "stages": [{"id": i, "label": label} for i, label in zip(STAGES, STAGE_LABELS)],
        "extent_definitions": {r.extent_type: r.definition for r in definitions.select("extent_type", "definition").collect()},
        "mechanisms": [{"id": k, "label": v} for k, v in MECHANISM_LABELS.items()],
        "entity_types": list(ENTITY_TYPES), "confidence_levels": list(CONFIDENCE_LEVELS), "stats": counts,
    }


def publish(tables_: dict[str, DataFrame], definitions: DataFrame, path: str, built: date, interviews: DataFrame | None = None, explainers_: DataFrame | None = None) -> str:
    """All tables, the JSON sidecars and the metadata with its evidence; returns the build id of what was written."""
    spark = definitions.sparkSession
    write(tables_, f"{path}/tables", built)
    for name, (records, header) in sidecars(tables_, interviews, explainers_).items():
        if name != "evidence":
            sinks.write_sidecar(records, f"{path}/sidecars/{name}", **header)
    build_id = sinks.build_id(spark, f"{path}/sidecars/*/records").first().build_id
    evidence = sidecars(tables_, None, explainers_)["evidence"][0]
    sinks.write_sidecar(evidence, f"{path}/meta", **metadata(tables_, definitions, built, build_id))
    return build_id


def write(tables_: dict[str, DataFrame], path: str, built: date) -> DataFrame:
    """Each table as Parquet, and one row of metadata for each; ``built`` is given, never today's date."""
    for name, df in tables_.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables_.values())).sparkSession
    return sinks.stats({n: spark.read.parquet(f"{path}/{n}") for n in tables_}).withColumn("built", F.lit(built))
