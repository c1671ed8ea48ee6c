"""Citations: each distinct piece of evidence once, by the hash of its content, and references on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

FIELDS = ("source_id", "title", "url", "document_date", "retrieved", "note")


def evidence_id(evidence: Column) -> Column:
    """Ten hex digits of the hash of the canonical JSON; empty fields don't count."""
    filled = F.struct(*[F.nullif(evidence[f].cast("string"), F.lit("")).alias(f) for f in sorted(FIELDS)])
    return F.substring(F.sha1(F.to_json(filled)), 1, 10)


def references(evidence: Column) -> Column:
    """The ids of a list of evidence, in order, each once."""
    return F.array_distinct(F.transform(evidence, evidence_id))


def hoist(rows: DataFrame, evidence: str = "evidence", nested: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``evidence_ref`` in place of their evidence, and the dictionary of what they cite.

    ``nested`` names lists of structs whose member of that name also holds evidence.
    """
    cited = rows.select(F.explode(evidence).alias("e"))
    out = rows.withColumn("evidence_ref", references(F.col(evidence)))
    for column, member in (nested or {}).items():
        cited = cited.unionByName(_nested(rows, column, member))
        out = out.withColumn(column, F.transform(column, _with_refs(member)))
    table = cited.where("e is not null").select(evidence_id(F.col("e")).alias("evidence_id"), *[F.col(f"e.{f}").alias(f) for f in FIELDS])
    table = table.groupBy("evidence_id").agg(*[F.min(f).alias(f) for f in FIELDS])  # equal but for empty against null
    return out.drop(evidence), table


def _nested(rows: DataFrame, column: str, member: str) -> DataFrame:
    return rows.select(F.explode(F.flatten(F.transform(column, lambda s: s[member]))).alias("e"))


def _with_refs(member: str):
    return lambda s: s.dropFields(member).withField("evidence_ref", references(s[member]))


def hoist_nested(rows: DataFrame, member: str = "evidence") -> tuple[DataFrame, DataFrame]:
    """As ``hoist``, for evidence at any depth: in members of that name of structs within lists, maps and structs.

    The nested type says where evidence is, so one pass rewrites all of it; each such member becomes
    ``<member>_ref``, and no body stays behind.
    """
    found = [_bodies(F.col(f"`{f.name}`"), f.dataType, f.name, member) for f in rows.schema]
    found = [c for c in found if c is not None]
    if not found:
        raise ValueError(f"no column holds {member}")
    out = rows.select(*[_rewritten(F.col(f"`{f.name}`"), f.dataType, f.name, member).alias(f"{member}_ref" if _is_body(f.name, f.dataType, member) else f.name) for f in rows.schema])
    cited = rows.select(F.explode(F.concat(*found)).alias("e"))
    table = cited.where("e is not null").select(evidence_id(F.col("e")).alias("evidence_id"), *[F.col(f"e.{f}").alias(f) for f in FIELDS])
    return out, table.groupBy("evidence_id").agg(*[F.min(f).alias(f) for f in FIELDS])


def _is_body(name: str, kind: DataType, member: str) -> bool:
    return name == member and isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)


def _bodies(value: Column, kind: DataType, name: str, member: str) -> Column | None:
    """All evidence inside a value as one list, null parts as none; None if its type holds none."""
    if _is_body(name, kind, member):
        return F.coalesce(value, F.array().cast(kind))
    if isinstance(kind, StructType):
        inner = [c for f in kind if (c := _bodies(value[f.name], f.dataType, f.name, member)) is not None]
        return F.concat(*inner) if inner else None
    items, element = _items(value, kind)
    if element is None or _bodies(F.lit(None), element, "", member) is None:
        return None
    return F.coalesce(F.flatten(F.transform(items, lambda v: _bodies(v, element, "", member))), F.array())


def _items(value: Column, kind: DataType) -> tuple[Column, DataType | None]:
    if isinstance(kind, ArrayType):
        return value, kind.elementType
    if isinstance(kind, MapType):
        return F.map_values(value), kind.valueType
    return value, None


def _rewritten(value: Column, kind: DataType, name: str, member: str) -> Column:
    if _is_body(name, kind, member):
        return references(value)
    if _bodies(value, kind, name, member) is None:
        return value
    if isinstance(kind, StructType):
        fields = [_rewritten(value[f.name], f.dataType, f.name, member).alias(f"{member}_ref" if _is_body(f.name, f.dataType, member) else f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: _rewritten(v, kind.valueType, "", member))
    return F.transform(value, lambda v: _rewritten(v, kind.elementType, "", member))


def dangling(rows: DataFrame, table: DataFrame, key: str, refs: str = "evidence_ref") -> DataFrame:
    """References that the table doesn't know: (key, evidence_id)."""
    used = rows.select(key, F.explode(refs).alias("evidence_id"))
    return used.join(table.select("evidence_id"), "evidence_id", "left_anti")


def resolve(rows: DataFrame, table: DataFrame, key: str, refs: str = "evidence_ref") -> DataFrame:
    """Each reference with its citation and place; unknown ones are left out, order is kept."""
    used = rows.select(key, F.posexplode(refs).alias("place", "evidence_id"))
    return used.join(table, "evidence_id")


def enabled_only(rows: DataFrame, sources: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows of sources that are registered and enabled."""
    return rows.join(sources.where("enabled").select(source), source, "left_semi")


def unregistered(rows: DataFrame, sources: DataFrame, source: str = "source_id") -> DataFrame:
    return rows.join(sources.where("enabled").select(source), source, "left_anti")


def fingerprint(files: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """One id for a set of files: twelve hex digits over names and digests in the order of names."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, digest))), lambda f: F.concat_ws(":", f[name], f[digest])), ";")
    return files.agg(F.substring(F.sha2(listed, 256), 1, 12).alias("build_id"))  # one short line for each published file


def manifest(spark, path: str) -> DataFrame:
    """``filename, sha256, bytes, retrieved`` of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("retrieved"))


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))  # combined before the shuffle
    return first.select("_row.*")


def attach(rows: DataFrame, source_id: str, title: str, url: str | None = None, document_date: str | None = None, retrieved: str | None = None, note: str | None = None) -> DataFrame:
    """Rows with one literal piece of evidence."""
    kinds = dict(zip(FIELDS, ("string", "string", "string", "date", "date", "string")))
    given = dict(zip(FIELDS, (source_id, title, url, document_date, retrieved, note)))
    return rows.withColumn("evidence", F.array(F.struct(*[F.lit(given[f]).cast(k).alias(f) for f, k in kinds.items()])))
