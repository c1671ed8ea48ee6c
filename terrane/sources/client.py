"""What a client loads: all layers of a published folder at once, lazily, and the search index at first use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.sources import tables

_INDEXES: dict[tuple[str, str], DataFrame] = {}


def load_all(spark: SparkSession, folder: str, schemas: dict[str, str], views: bool = True) -> dict[str, DataFrame]:
    """Each named layer under a folder as a lazy table, and as a temporary view of its name; one that is missing has no rows.

    Nothing is read but the files' footers; Spark runs what is asked of several layers side by side.
    """
    out = {name: tables.optional(spark, f"{folder}/{name}", schema) for name, schema in schemas.items()}
    if views:
        for name, layer in out.items():
            layer.createOrReplaceTempView(name)
    return out


def search_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The index under a path, read when it is first asked for and kept by the executors from then on; empty where there is none."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _INDEXES:
        _INDEXES[key] = tables.optional(spark, path, schema).persist()
    return _INDEXES[key]
