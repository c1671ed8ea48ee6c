"""Writing layers: Parquet by extent type with its empty members, and sidecars with counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import provenance


def write_extents(features: DataFrame, vocabulary: DataFrame, path: str, kind: str = "extent_type") -> None:
    """Features by extent type, and one row for each type of the vocabulary with its definition and count."""
    features.write.mode("overwrite").partitionBy(kind).parquet(f"{path}/features")
    counted = vocabulary.join(features.groupBy(kind).agg(F.count("*").alias("n")), kind, "left").fillna(0, ["n"])
    counted.write.mode("overwrite").parquet(f"{path}/layers")


def write_layer(features: DataFrame, path: str, nested: dict[str, str] | None = None) -> None:
    """Rows with references beside the dictionary of what they cite."""
    rows, table = provenance.hoist(features, nested=nested)
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    table.write.mode("overwrite").parquet(f"{path}/evidence")


def write_split(rows: DataFrame, flag: str, path: str) -> None:
    """Kept and withheld rows in two folders; what is withheld is never lost."""
    kept = F.coalesce(F.col(flag), F.lit(False))
    rows.where(kept).write.mode("overwrite").parquet(f"{path}/rendered")
    rows.where(~kept).write.mode("overwrite").parquet(f"{path}/withheld")


def write_sidecar(records: DataFrame, path: str, **header) -> None:
    """A plain JSON sidecar: one line of header, and a line for each record without its empty members.

    ``header`` holds plain values; ``count`` is added to it. Records are written where they are, not gathered.
    """
    filled = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]), {"ignoreNullFields": "true"})
    records.select(filled.alias("value")).write.mode("overwrite").text(f"{path}/records")
    count = records.sparkSession.read.text(f"{path}/records").count()
    line = json.dumps(header | {"count": count}, ensure_ascii=False, sort_keys=True, default=str)
    records.sparkSession.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/header")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``name, rows`` of each table."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def build_id(spark, path: str) -> DataFrame:
    """The fingerprint of all files under a path but the metadata's own; a writer's random part of a name doesn't count."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.regexp_extract("path", "((?:[^/]+/){0,2}[^/]+)$", 1), "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    files = files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"))
    return provenance.fingerprint(files.where(~F.element_at(F.split("name", "/"), -1).startswith("meta")))
