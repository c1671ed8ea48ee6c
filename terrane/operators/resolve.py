"""Entity resolution: blocked nearest neighbours, survivor merges, withheld conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.config import SETTINGS
from terrane.functions import geometry as G
from terrane.functions import text as T
from terrane.operators import ordered


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius_m: float, same=None, x: str = "x", y: str = "y", cell: float = SETTINGS.block_cell_deg) -> DataFrame:
    """Each left row's nearest right row within the radius: ``left_key, right_key, distance_m``.

    Candidates share one of the nine cells around; a cell must be as wide as the radius. ``same``
    is a cheap condition on the joined rows. Equal distances go to the smaller right key.
    """
    if radius_m > cell * SETTINGS.metres_per_degree * 0.84:
        raise ValueError("the radius exceeds a cell: neighbouring cells would not hold all candidates")
    a = left.withColumns({"_lx": F.col(x), "_ly": F.col(y)}).withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)}).drop(x, y)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.withColumns({"_rx": F.col(x), "_ry": F.col(y)}).drop(x, y).withColumn("_step", F.explode(steps))
    b = b.withColumns({"_cx": F.floor(F.col("_rx") / cell) + F.col("_step.i"), "_cy": F.floor(F.col("_ry") / cell) + F.col("_step.j")}).drop("_step")
    near = a.join(b, ["_cx", "_cy"]).withColumn("distance_m", G.metres(F.col("_lx"), F.col("_ly"), F.col("_rx"), F.col("_ry")))
    near = near.where(F.col("distance_m") <= radius_m)
    if same is not None:
        near = near.where(same)
    best = near.groupBy(left_key).agg(F.min(F.struct("distance_m", right_key)).alias("_best"))
    return best.select(left_key, F.col(f"_best.{right_key}").alias(right_key), F.col("_best.distance_m").alias("distance_m"))


def matched_pairs(current: DataFrame, historic: DataFrame, settings=SETTINGS) -> DataFrame:
    """Historic localities and the current ones they are: ``historic_id, current_id, distance_m, wide``.

    Names must be of one place. What is surely the same needs no ratio; only the other near
    candidates go through the sequence ratio. Equal distances go to the first in source order.
    Depopulated localities match nothing.
    """
    h = historic.where("not coalesce(depopulated_1948, false)").select(F.col("locality_id").alias("historic_id"), "x", "y", T.compare_key(F.col("name")).alias("_hk"))
    c = current.select(F.col("locality_id").alias("current_id"), F.col("ord").alias("_co"), "x", "y", T.compare_key(F.col("name")).alias("_ck"))
    cell = settings.block_cell_deg
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = h.select("historic_id", "_hk", F.col("x").alias("hx"), F.col("y").alias("hy"), G.block_cell(F.col("x")).alias("cx"), G.block_cell(F.col("y")).alias("cy"))
    right = c.select("current_id", "_co", "_ck", F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(steps).alias("s"))
    right = right.select("current_id", "_co", "_ck", "qx", "qy", (G.block_cell(F.col("qx")) + F.col("s.i")).alias("cx"), (G.block_cell(F.col("qy")) + F.col("s.j")).alias("cy"))
    near = left.join(right, ["cx", "cy"]).withColumn("distance_m", G.metres(F.col("hx"), F.col("hy"), F.col("qx"), F.col("qy")))
    near = near.where((F.col("distance_m") <= settings.wide_radius_m) & (F.length("_hk") > 0) & (F.length("_ck") > 0))
    near = near.withColumn("_sure", T.surely_same(F.col("_hk"), F.col("_ck")))
    fuzzy = near.where("not _sure").where(T.sequence_ratio(F.col("_hk"), F.col("_ck")) >= settings.name_similarity)
    pairs = near.where("_sure").unionByName(fuzzy).groupBy("historic_id").agg(F.min(F.struct("distance_m", "_co", "current_id")).alias("b"))
    return pairs.select("historic_id", F.col("b.current_id").alias("current_id"), F.col("b.distance_m").alias("distance_m"), (F.col("b.distance_m") > settings.merge_radius_m).alias("wide"))


def merged_population(first: Column, second: Column) -> Column:
    """Entries of both lists, the first of each (year, grp), ordered by year and group."""
    both = F.concat(F.coalesce(first, F.array()), F.coalesce(second, F.array()))
    kept = F.filter(
        F.transform(both, lambda e, i: F.struct(F.coalesce(e["year"], F.lit(0)).alias("y"), F.coalesce(e["grp"], F.lit("")).alias("g"), i.alias("i"), e.alias("e"))),
        lambda r: ~F.exists(F.slice(both, 1, r["i"]), lambda o: o["year"].eqNullSafe(r["e"]["year"]) & o["grp"].eqNullSafe(r["e"]["grp"])),
    )
    return F.transform(F.array_sort(kept), lambda r: r["e"])


#: What a record takes from the records merged into it, where it has such a column: the first value that is there
#: (its own first), the last value that is there (else its own), or what the last record says, nothing included.
FIRST_FACTS = ("arabic", "hebrew", "pre_1948", "district", "subdistrict")
LATEST_FACTS = ("slug", "oral_histories")
OTHERS_FACTS = ("depopulated_1948", "depopulated_date", "status_now", "group_1945", "group_now", "mechanism")


def absorbed(survivors: DataFrame, others: DataFrame, pairs: DataFrame, order: list[str]) -> DataFrame:
    """``survivors`` completed from the ``others`` that pairs (``historic_id, current_id``) give them, one after another by ``order``.

    A survivor keeps its id, name, position and its own values of ``FIRST_FACTS``; texts that are empty are as
    if missing. The names of the others become transliterations unless they are its own name when
    normalised. Population entries are joined by year and group, references with its own on top and then the
    earlier ones, evidence in order. ``historic_point`` is the last one's position where that differs.
    Values are folded by aggregates; only what the result lists (names, population, evidence, references) is gathered.
    """
    c, o = survivors, others
    have = [n for n in (*FIRST_FACTS, *LATEST_FACTS, *OTHERS_FACTS) if n in c.columns and n in o.columns]
    there = lambda n: F.col(n).isNotNull() & (F.col(n) != "") if dict(o.dtypes)[n] == "string" else F.col(n).isNotNull()
    by = F.struct(*order)
    value = lambda n: F.struct(F.col(n).alias("v"))  # noqa: E731  a null inside a struct is not skipped
    joined = pairs.select("historic_id", "current_id").join(o, o.locality_id == pairs.historic_id)
    folds = []
    for n in have:
        if n in FIRST_FACTS:
            folds.append(F.min_by(n, F.when(there(n), by)).alias(f"_{n}"))
        elif n in LATEST_FACTS:
            folds.append(F.max_by(n, F.when(there(n), by)).alias(f"_{n}"))
        else:
            folds.append(F.max_by(value(n), by).alias(f"_{n}"))
    lists = joined.groupBy("current_id").agg(
        F.max_by(F.struct("x", "y"), by).alias("_point"), *folds,
        F.array_sort(F.collect_list(F.struct(by.alias("o"), "name", "population", "refs", "evidence")), _by_order).alias("_l"),
    )
    both = c.join(lists, c.locality_id == lists.current_id, "left")
    _l = F.coalesce("_l", F.array().cast(lists.schema["_l"].dataType))
    none = lambda n: F.array().cast(c.schema[n].dataType)
    own = lambda n: F.nullif(F.col(n), F.lit("")) if dict(c.dtypes)[n] == "string" else F.col(n)
    new = {}
    for n in have:
        if n in FIRST_FACTS:
            new[n] = F.coalesce(own(n), F.col(f"_{n}"), F.col(n))
        elif n in LATEST_FACTS:
            new[n] = F.coalesce(f"_{n}", n)
        else:
            new[n] = F.when(F.col("current_id").isNull(), F.col(n)).otherwise(F.col(f"_{n}.v"))
    variants = F.filter(F.transform(_l, lambda r: r["name"]), lambda n: T.normalise(n) != T.normalise(F.col("name")))
    new["transliterations"] = F.concat(F.coalesce("transliterations", F.array().cast("array<string>")), variants)
    new["population"] = F.aggregate(_l, F.coalesce("population", none("population")), lambda acc, r: merged_population(acc, r["population"]))
    new["refs"] = merged_maps(F.reverse(F.transform(_l, lambda r: r["refs"])), F.col("refs"))
    new["evidence"] = F.concat(F.coalesce("evidence", none("evidence")), F.flatten(F.transform(_l, lambda r: F.coalesce(r["evidence"], none("evidence")))))
    moved = (F.col("_point.x") != F.col("x")) | (F.col("_point.y") != F.col("y"))
    before = F.col("historic_point") if "historic_point" in c.columns else F.lit(None).cast("struct<x:double,y:double>")
    new["historic_point"] = F.when(F.col("current_id").isNull(), before).otherwise(F.when(moved, F.col("_point")))
    columns = [n for n in c.columns if n != "historic_point"]
    return both.select(*[new.get(n, F.col(n)).alias(n) for n in (*columns, "historic_point")])


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


def merge_localities(current: DataFrame, historic: DataFrame, pairs: DataFrame) -> DataFrame:
    """Current localities completed from their historic records, and the historic ones without a match.

    Several historic records of one place are merged one after another in source order; ``source_part`` is 0 for
    rows of the current source and 1 for the historic ones that stand alone.
    """
    out = absorbed(current, historic, pairs, ["ord"]).withColumn("source_part", F.lit(0))
    rest = historic.join(pairs, historic.locality_id == pairs.historic_id, "left_anti").withColumn("historic_point", F.lit(None).cast("struct<x:double,y:double>"))
    return out.unionByName(rest.withColumn("source_part", F.lit(1)).select(*out.columns))


def merge_coincident(judged: DataFrame, order: list[str]) -> DataFrame:
    """The records to keep of ``coordinate_conflicts``, each with what merges into it at its position, in order."""
    keep = judged.where("decision = 'keep'")
    others = judged.where("decision = 'merge'")
    pairs = others.select(F.col("locality_id").alias("historic_id"), F.col("survivor_id").alias("current_id"))
    return absorbed(keep, others.drop("decision", "survivor_id", "reason"), pairs, order).drop("decision", "survivor_id", "reason")


def merged_maps(older: Column, newer: Column) -> Column:
    """One map, later entries and then the newer map winning."""
    empty = F.create_map().cast("map<string,string>")
    zipped = F.aggregate(F.coalesce(older, F.array().cast("array<map<string,string>>")), empty, lambda acc, m: F.map_zip_with(acc, F.coalesce(m, empty), lambda k, a, b: F.coalesce(b, a)))
    return F.map_zip_with(zipped, F.coalesce(newer, empty), lambda k, a, b: F.coalesce(b, a))


def coordinate_conflicts(localities: DataFrame, settings=SETTINGS, order: tuple[str, ...] = ("ord", "locality_id")) -> DataFrame:
    """Every locality with ``decision`` keep, merge or withhold, ``survivor_id`` and ``reason``.

    Localities at one position are one place when all their names are that of the first: they
    merge into the first authoritative record, else the first. Otherwise a single authoritative
    record stays and the others are withheld; without one, or with several, all are.
    """
    rows = localities.withColumn("_key", T.compare_key(F.col("name"))).withColumn("_own", ~F.col("locality_id").startswith(settings.withheld_prefix))
    at = Window.partitionBy("x", "y")
    rows = rows.withColumn("_n", F.count("*").over(at)).withColumn("_first", F.first("_key").over(at.orderBy(*order)))
    shared = rows.where("_n > 1").withColumn("_sure", T.surely_same(F.col("_key"), F.col("_first")))
    shared = shared.withColumn("_same", F.col("_sure") | (T.sequence_ratio(F.col("_key"), F.col("_first")) >= settings.name_similarity))
    own = F.struct((~F.col("_own")).alias("o"), *order, *(() if "locality_id" in order else ("locality_id",)))
    place = shared.groupBy("x", "y").agg(F.bool_and("_same").alias("_all"), F.count_if("_own").alias("_n_own"), F.min(own).alias("_best"))
    shared = shared.join(place, ["x", "y"])
    best = F.col("_best.locality_id")
    decision = F.when(F.col("_all"), F.when(F.col("locality_id") == best, "keep").otherwise("merge")).when(
        F.col("_n_own") == 1, F.when(F.col("_own"), "keep").otherwise("withhold")
    )
    reason = F.when(~F.col("_all") & (F.col("_n_own") == 1) & ~F.col("_own"), "collides with a more authoritative record").when(
        ~F.col("_all") & (F.col("_n_own") != 1), "identical coordinates, neither record outranks the other"
    )
    names = localities.columns
    shared = shared.select(*names, F.coalesce(decision, F.lit("withhold")).alias("decision"), F.when(F.col("_all") | (F.col("_n_own") == 1), best).alias("survivor_id"), reason.alias("reason"))
    alone = rows.where("_n = 1").select(*names, F.lit("keep").alias("decision"), F.col("locality_id").alias("survivor_id"), F.lit(None).cast("string").alias("reason"))
    return alone.unionByName(shared)


def unique_ids(records: DataFrame, key: str, order: str, out: str = "unique_id", parts: int | None = None) -> DataFrame:
    """Rows in order, each with the first of ``a``, ``a-2``, ``a-2-2``, ... from its own key on that no earlier row has.

    Keys that differ only by such suffixes are a family, and its suffixes are slots. A family is walked in
    order over as many partitions as it has (``ordered.free_slots``). Rows with a null key keep it.
    """
    rows = records.withColumn("_stem", F.regexp_replace(key, "(-2)+$", ""))
    rows = rows.withColumn("_level", ((F.length(key) - F.length("_stem")) / 2).cast("int"))
    known = ordered.free_slots(rows.where(F.col(key).isNotNull()), "_stem", [order], "_level", "_slot", parts)
    known = known.withColumn(out, F.concat("_stem", F.repeat(F.lit("-2"), F.col("_slot"))))
    none = records.where(F.col(key).isNull()).withColumn(out, F.lit(None).cast("string"))
    return known.select(*none.columns).unionByName(none)


def append_missing(current: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All current rows, and those others whose key is not among them."""
    return current.unionByName(other.join(current.select(key), key, "left_anti").select(*current.columns))


def apply_overrides(localities: DataFrame, overrides: DataFrame, key: str = "locality_id", fields: tuple[str, ...] = ("hebrew",)) -> DataFrame:
    """Curated values where a field is missing; ``overridden`` says that one was used.

    Where both sides have ``evidence``, that of a used override is added to the row's own.
    """
    cites = "evidence" in localities.columns and "evidence" in overrides.columns
    o = overrides.select(F.col(key), *[F.col(f).alias(f"_o_{f}") for f in (*fields, *(("evidence",) if cites else ()))])
    joined = localities.join(o, key, "left")
    used = F.lit(False)
    for f in fields:
        used = used | (joined[f].isNull() & F.col(f"_o_{f}").isNotNull())
    joined = joined.withColumn("overridden", used)
    if cites:
        none = F.array().cast(localities.schema["evidence"].dataType)
        added = F.when(F.col("overridden"), F.coalesce("_o_evidence", none)).otherwise(none)
        joined = joined.withColumn("evidence", F.concat(F.coalesce("evidence", none), added)).drop("_o_evidence")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f, f"_o_{f}"))
    return joined.drop(*[f"_o_{f}" for f in fields])


def propagate_names(targets: DataFrame, sources: DataFrame, field: str = "hebrew", settings=SETTINGS) -> DataFrame:
    """A missing field from the first source of the same compared name within the wide radius.

    Positions meet, not records: of the sources of one name at one position only the first counts, and targets of one
    name at one position get the same. So pairs grow with the different positions in reach, never with the records there.
    """
    t = targets.where(F.col(field).isNull()).select("locality_id", "x", "y", T.compare_key(F.col("name")).alias("_key"))
    s = sources.where(F.col(field).isNotNull()).select(F.col("x").alias("_x"), F.col("y").alias("_y"), "ord", F.col(field).alias("_value"), T.compare_key(F.col("name")).alias("_key"))
    first = F.min(F.when(F.col("ord").isNotNull(), F.struct("ord", "_value"))).alias("_first")
    s = s.groupBy("_key", "_x", "_y").agg(first)
    at = ["_key", "x", "y"]
    cells = ["_key", "_cx", "_cy"]  # a common name is one key for each cell, not one for all
    near = G.own_cell(t.select(*at).distinct(), "x", "y").join(G.around(s, "_x", "_y"), cells).where(G.metres(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) <= settings.wide_radius_m)
    places = near.groupBy(*at).agg(F.min("_first").alias("_first"))
    found = t.join(places, at).groupBy("locality_id").agg(F.min("_first")["_value"].alias("_value"))
    return targets.join(found, "locality_id", "left").withColumn(field, F.coalesce(field, "_value")).drop("_value")
