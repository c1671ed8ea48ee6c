"""Loaders: from the records of a landed file to a layer with evidence on every row.

Records have ``ord``, ``attributes`` (a map of texts), ``geom`` and ``source_crs``, as the shapefile
reader makes them. ``cite`` holds what the evidence says of the file: ``source_id``, ``title``, ``url``,
``document_date``, ``retrieved``, ``note``. Dates of retrieval are given, never today's.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.config import TYPE_MAP
from terrane.functions import crs, dates, values
from terrane.functions import geometry as G
from terrane.functions import text as T
from terrane.operators import provenance, resolve, spatial

# Fields of the sources, as they are spelt there, and states that mean a place is gone.
DEPOPULATED = ("Depopulated", "Depopulated & built over", "Depopulated & appropriated", "Abandoned")
FACILITY_ALIASES = {"Sub Station": "Sub-Station"}
CENSUS = ((1922, "pop_1922", None), (1931, "pop_1931", None), (1945, "pop_1945", None), (1945, "pal_1945", "Palestinian"), (1945, "jsh_1945", "Jewish"), (2016, "pop_2016", None))
BLANK_NAME = "Name field blank in the source dataset; requires manual identification."
CONTRADICTION = "Source population figures are internally inconsistent for this locality; the contradictory group figure is withheld."
RELABELLED = "Source labelled this polygon 'A'. Reassigned to Area B: it contains none of the Area A city centres, which all fall inside the other 'A' polygon."
CONSTRUCTION = 4


def field(name: str) -> Column:
    """An attribute as trimmed text, null when blank or missing."""
    return T.clean(F.col("attributes").getItem(name))


def _cited(rows: DataFrame, cite: dict, note: Column | None = None, day: Column | None = None) -> DataFrame:
    """Rows with one piece of evidence; a note or a date of its own replaces the file's."""
    out = provenance.attach(rows, **cite)
    e = F.col("evidence")[0]
    if note is not None:
        e = e.withField("note", F.coalesce(note, e["note"]))
    if day is not None:
        e = e.withField("document_date", day)
    return out.withColumn("evidence", F.array(e))


def oslo_areas(records: DataFrame, anchors: DataFrame, cite: dict) -> DataFrame:
    """``ord, oslo_class, geom, class_corrected``: of two polygons labelled A, the one without the anchors is B.

    ``anchors`` are ``anchor, x, y``. The query fails rather than guess when they don't all lie in one polygon.
    """
    rows = records.select("ord", F.coalesce(field("CLASS"), F.lit("")).alias("oslo_class"), "geom", "source_crs")
    return _cited(spatial.relabel(rows, anchors, "anchor", "ord", "oslo_class", "A", "B", RELABELLED), cite)


def settlements(records: DataFrame, cite: dict, observed: date, east_jerusalem: DataFrame | None = None, identifications: DataFrame | None = None) -> DataFrame:
    """Built-up polygons as entities: parts of one ``GIS_ID`` are one place, named by whichever part has a name.

    Polygons without a name or id stay, as ``Unidentified settlement (key)``. An identification (``key,
    given, x, y, title, url, identified, method``) applies only where its anchor still lies in the polygon;
    ``outcome`` tells. A place whose centre lies in East Jerusalem (one row with ``geom``) has a type of its own.
    """
    rows = records.select("ord", field("GIS_ID").try_cast("double").alias("gid"), field("Name").alias("own"), "geom", "source_crs")
    rows = rows.withColumn("gid", F.when(F.col("gid") != 0, F.col("gid")))
    by_gid = rows.where("gid is not null and own is not null").groupBy("gid").agg(F.min_by("own", "ord").alias("shared"))
    rows = rows.join(by_gid, "gid", "left").withColumn("name", F.coalesce("own", "shared"))
    key = F.when(F.col("gid").isNotNull(), F.concat(F.lit("gid-"), F.col("gid").cast("bigint").cast("string")))
    key = F.coalesce(key, F.concat(F.lit("name-"), T.slug(F.col("name"))), F.concat(F.lit("orphan-"), F.col("ord").cast("string")))
    key = F.when(F.col("gid").isNull() & F.col("name").isNull(), F.concat(F.lit("orphan-"), F.col("ord").cast("string"))).otherwise(key)
    rows = rows.withColumn("key", key)
    names = rows.groupBy("key").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"), F.min("source_crs").alias("source_crs"))
    whole = spatial.assembled(rows, "key").join(names, "key")
    kind = F.when(F.size("geom.parts") == 1, "Polygon").otherwise("MultiPolygon")
    whole = whole.withColumn("geom", F.struct(kind.alias("kind"), F.col("geom.parts").alias("parts")))
    whole = whole.withColumn("_base", F.when(F.col("name").isNotNull(), T.slug(F.col("name"))).otherwise(F.col("key")))
    whole = resolve.unique_ids(whole, "_base", "ord", "entity_id").drop("_base")
    if identifications is None:
        identifications = whole.sparkSession.createDataFrame([], "key string, given string, x double, y double, title string, url string, identified date, method string")
    known = F.broadcast(identifications) if identifications.limit(10_001).count() <= 10_000 else identifications  # curated by hand
    whole = whole.join(known, "key", "left")
    held = G.contains(F.col("geom.parts"), F.col("x"), F.col("y"))
    outcome = F.when(F.col("name").isNotNull() | F.col("given").isNull(), None).when(held, "applied").otherwise("refused")
    whole = whole.withColumn("outcome", outcome).withColumn("_c", G.ring_center(F.col("geom.parts")))
    applied = F.coalesce(F.col("outcome") == "applied", F.lit(False))
    display = F.coalesce("name", F.when(applied, F.col("given")), F.concat(F.lit("Unidentified settlement ("), "key", F.lit(")")))
    inside = F.lit(False)
    if east_jerusalem is not None:
        whole = whole.join(F.broadcast(east_jerusalem.limit(1).select(F.col("geom.parts").alias("_ej"))), F.lit(True), "left")  # one row
        inside = F.col("_ej").isNotNull() & G.contains(F.col("_ej"), F.col("_c.x"), F.col("_c.y"))
    cited = _cited(whole, cite, note=F.when(F.col("name").isNull() & ~applied, F.lit(BLANK_NAME)))
    e = F.col("evidence")[0]
    second = F.struct(
        F.lit("wikidata").alias("source_id"), F.col("title"), F.col("url"), F.col("identified").alias("document_date"), F.col("identified").alias("retrieved"), F.col("method").alias("note")
    )
    return cited.select(
        "entity_id", "ord", "key", display.alias("name"), F.when(inside, "ej_settlement").otherwise("settlement").alias("type"), "outcome", "geom", "source_crs",
        F.lit("built_up").alias("extent_type"), crs.area_m2(F.col("geom.parts")).alias("area_m2"),
        dates.minimum_stage(CONSTRUCTION, F.lit(observed), F.array(e)).alias("stage_history"),
        F.when(applied, F.array(e, second)).otherwise(F.array(e)).alias("evidence"),
    )


def boundaries(features: DataFrame, cite: dict, observed: date) -> DataFrame:
    """Typed outlines of settlements and outposts; ``attributes`` as of a GeoJSON file. Unknown types are settlements."""
    display = F.coalesce(field("NameEng"), field("Name"), F.lit("Unnamed"))
    rows = features.select("ord", "geom", display.alias("name"), field("Name").alias("hebrew"), field("Type").alias("raw_type"))
    rows = rows.withColumn("type", values.vocabulary(F.col("raw_type"), TYPE_MAP, "settlement")).withColumn("_base", F.concat(F.lit("bts-"), T.slug(F.col("name"), collapse=False)))
    rows = _cited(resolve.unique_ids(rows, "_base", "ord", "entity_id").drop("_base"), cite)
    return rows.withColumn("area_m2", crs.area_m2(F.col("geom.parts"))).withColumn("extent_type", F.lit("settlement_boundary")).withColumn("stage_history", dates.minimum_stage(CONSTRUCTION, F.lit(observed), F.col("evidence")))


def unknown_terms(rows: DataFrame, column: str, table: dict[str, str]) -> DataFrame:
    """The distinct values that a vocabulary doesn't know, with how often each occurs."""
    strange = rows.where(values.vocabulary(F.col(column), table).isNull())
    return strange.groupBy(column).agg(F.count("*").alias("n"))


def localities(records: DataFrame, oslo: DataFrame, cite: dict, excluded: str = "gaza") -> DataFrame:
    """Communities as localities; regions that start with ``excluded`` are out of scope, population is a figure or a note."""
    rows = records.where(~F.coalesce(F.lower(field("Region")).startswith(excluded), F.lit(False)))
    point = F.col("geom.parts")[0][0][0]
    rows = rows.withColumns({"name": F.coalesce(field("PCBS_NAME"), F.lit("Unnamed locality")), "x": point["x"], "y": point["y"]})
    rows = rows.withColumn("locality_id", F.coalesce(field("PCODE"), T.slug(F.col("name"))))
    held = spatial.first_match(rows, oslo.select("oslo_class", F.col("ord").alias("_order"), "geom"), "ord", "oslo_class", "_order", field("Oslo_Areas"))
    figure = values.number_or_note(F.col("attributes").getItem("pop2017"))
    entry = F.struct(F.lit(2017).alias("year"), figure["value"].alias("value"), F.lit(None).cast("string").alias("grp"), figure["note"].alias("note"), F.lit(cite["source_id"]).alias("source_id"))
    told = figure["value"].isNotNull() | figure["note"].isNotNull()
    population = F.when(told, F.array(entry)).otherwise(F.array().cast("array<struct<year:int,value:bigint,grp:string,note:string,source_id:string>>"))
    return _cited(held, cite).select(
        "locality_id", "ord", "name", field("NAME_ARB").alias("arabic"), "x", "y", field("District").alias("district"),
        (F.coalesce(field("EJ"), F.lit("")) == "1").alias("in_east_jerusalem"), population.alias("population"), F.col("oslo_class").alias("oslo_area"), "evidence",
    )


def firing_zones(records: DataFrame, cite: dict) -> DataFrame:
    """Closed areas with the day their order was signed; garbled names are dropped, the date is the evidence's too."""
    name, signed = T.clean_label(F.col("attributes").getItem("FIRE_NAME")), F.try_to_date(field("SIGN_DATE"))
    rows = records.select(
        "ord", "geom", "source_crs", name.alias("zone_name"), F.coalesce(F.concat(F.lit("Firing zone "), name), F.lit("Firing zone (unnumbered)")).alias("name"),
        signed.alias("signed_date"), F.lit("closed_military_area").alias("mechanism"), crs.area_m2(F.col("geom.parts")).alias("area_m2"),
    )
    return _cited(rows, cite, day=F.col("signed_date"))


def village_boundaries(records: DataFrame, cite: dict) -> DataFrame:
    name = F.coalesce(T.clean_label(F.col("attributes").getItem("VNAME")), F.lit("Unnamed village"))
    return _cited(records.select("ord", "geom", "source_crs", name.alias("name"), crs.area_m2(F.col("geom.parts")).alias("area_m2")), cite)


def barrier(records: DataFrame, cite: dict) -> DataFrame:
    """All attributes as they are; a file without the layer gives no rows."""
    return _cited(records, cite)


def gaza_municipal(records: DataFrame, cite: dict, currency: str) -> DataFrame:
    name = field("NAME")
    rows = records.select("ord", "geom", "source_crs", F.coalesce(name, F.lit("Unnamed municipality")).alias("name"), name.isNotNull().alias("named"), F.lit("gaza").alias("region"), F.lit(currency).alias("currency_note"))
    return _cited(rows, cite)


def gaza_neighbourhoods(records: DataFrame, cite: dict, currency: str) -> tuple[DataFrame, DataFrame]:
    """The layer, and one row of how many have a district, community and Arabic name."""
    rows = records.select(
        "ord", "geom", "source_crs", F.coalesce(field("Neighbourh"), F.lit("Unnamed neighbourhood")).alias("name"), field("NameARB").alias("arabic"), field("DISTRICT").alias("district"),
        field("Communithy").alias("community"), field("PCODE").alias("pcode"), F.lit("gaza").alias("region"), F.lit(currency).alias("currency_note"),
    )
    stats = rows.agg(F.count("*").alias("total"), *[F.count(c).alias(f"with_{c}") for c in ("district", "community", "arabic")])
    return _cited(rows, cite), stats


def facilities(records: DataFrame, cite: dict, operator: str) -> dict[str, DataFrame]:
    """``plotted`` and ``withheld`` facilities, and ``by_type`` counts: what has no usable position is never plotted."""
    point = F.col("geom.parts")[0][0][0]
    kind = F.coalesce(field("Type"), F.lit("Unspecified"))
    aliases = F.create_map(*[F.lit(v) for pair in FACILITY_ALIASES.items() for v in pair])
    rows = records.select(
        "ord", "geom", "source_crs", F.coalesce(field("name"), F.lit("Unnamed facility")).alias("name"), F.coalesce(F.try_element_at(aliases, kind), kind).alias("facility_type"),
        field("District").alias("district"), F.lit(operator).alias("operator"), F.lit(cite.get("note")).alias("currency_note"),
        (F.coalesce(F.col("geom.kind") == "Point", F.lit(False)) & values.usable_coordinates(point["x"], point["y"])).alias("_usable"),
    )
    cited = _cited(rows, cite)
    plotted = cited.where("_usable").drop("_usable")
    by_type = plotted.groupBy("facility_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facility_type")
    return {"plotted": plotted, "withheld": cited.where("not _usable").select("ord", "name"), "by_type": by_type}


def historic(rows: DataFrame, cite: dict, excluded_district: str = "sinai") -> DataFrame:
    """Localities of a delimited file of texts: census figures by year and group, depopulation, references.

    Rows without coordinates and of the excluded district go. A group's figure over the total is withheld
    and the evidence says so. Only states of loss that ended from 1947 to 1950 count as depopulated then.
    """
    t = lambda c: T.clean(F.col(c))
    rows = rows.where(~F.coalesce(F.lower(t("district_1945")) == excluded_district, F.lit(False)))
    lon, lat = values.parsed_coordinate(F.col("lng")), values.parsed_coordinate(F.col("lat"))
    rows = rows.withColumns({"_x": lon, "_y": lat}).where("_x is not null and _y is not null")
    total, group = values.whole_number(F.col("pop_1945")), values.whole_number(F.col("pal_1945"))
    conflict = F.coalesce(group > total, F.lit(False))

    def entry(year, column, label):
        figure = values.whole_number(F.col(column))
        if label == "Palestinian":
            figure = values.within_total(figure, total)
        made = F.struct(F.lit(year).alias("year"), figure.alias("value"), F.lit(label).cast("string").alias("grp"), F.lit(None).cast("string").alias("note"), F.lit(cite["source_id"]).alias("source_id"))
        return F.when(figure.isNotNull(), made)

    gone = values.depopulation(t("change_2016"), t("end"), DEPOPULATED)
    refs = F.map_filter(
        F.create_map(
            F.lit("palestine_remembered"), F.concat(F.lit("https://www.palestineremembered.com/"), t("url_pr"), F.lit("/index.html")),
            F.lit("zochrot"), F.concat(F.lit("https://www.zochrot.org/villages/view/"), t("id_zo"), F.lit("/en")),
        ), lambda k, v: v.isNotNull(),
    )
    cited = _cited(rows, cite, note=F.when(conflict, F.lit(CONTRADICTION)))
    return cited.select(
        F.concat(F.lit("pom-"), "id").alias("locality_id"), F.col("id").try_cast("bigint").alias("ord"), F.coalesce(t("name_en"), F.lit("Unnamed locality")).alias("name"), t("name_ar").alias("arabic"), t("name_he").alias("hebrew"),
        F.array().cast("array<string>").alias("transliterations"), F.round("_x", 6).alias("x"), F.round("_y", 6).alias("y"), t("slug").alias("slug"), t("district_1945").alias("district"), t("subdistrict_1945").alias("subdistrict"),
        F.array_compact(F.array(*[entry(*c) for c in CENSUS])).alias("population"), gone["mechanism"].isNotNull().alias("depopulated_1948"), t("end").alias("depopulated_date"), t("change_2016").alias("status_now"),
        t("grp_1945").alias("group_1945"), t("grp_2016").alias("group_now"), gone["mechanism"].alias("mechanism"), refs.alias("refs"), conflict.alias("figures_conflict"), "evidence",
    )
