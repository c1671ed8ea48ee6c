"""Delimited files, JSON caches, curated dimensions and the registry of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVIEW = "interview_id string, name_en string, name_ar string, year string, duration string, language string, format string, collection string"
SOURCE = "source_id string, licence string, enabled boolean, attribution string, currency_note string"


def csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text; a byte-order mark is skipped."""
    return spark.read.csv(path, header=True, sep=separator, encoding="UTF-8", multiLine=True, escape='"')


def interviews(spark: SparkSession, path: str, template: str) -> DataFrame:
    """A folder of one JSON list for each slug: ``slug`` and eight fields; entries without an id go.

    ``template`` makes the address from the id (``%s``). Members that can't be read are skipped.
    """
    rows = spark.read.schema(INTERVIEW).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = rows.select("*", slug.alias("slug")).where("coalesce(trim(interview_id), '') <> ''")
    return rows.withColumn("url", F.format_string(template, "interview_id"))


def by_slug(localities: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """Localities with their interviews as a list, in the order of ids; the first ``most`` of them."""
    fields = [c for c in rows.columns if c != "slug"]
    grouped = rows.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("oral_histories"))  # interviews of one village
    if most is not None:
        grouped = grouped.withColumn("oral_histories", F.slice("oral_histories", 1, most))
    return localities.join(grouped, "slug", "left")


def keyed_json(spark: SparkSession, path: str, member: str) -> DataFrame:
    """A JSON object of key to struct as rows ``key, <members>``; keys that start with ``_`` are notes."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,struct<{member}>>")).alias("key", "v"))
    return rows.where(~F.col("key").startswith("_")).select("key", "v.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers of a catalogue's package search: ``package, format, url, place`` of every resource, in order.

    Packages without resources have none; answers that can't be read are skipped.
    """
    package = "struct<name:string,resources:array<struct<format:string,url:string>>>"
    answers = spark.read.text(path, wholetext=True).select(F.from_json("value", f"result struct<results:array<{package}>>").alias("a"))
    packages = answers.select(F.explode("a.result.results").alias("p"))
    return packages.select(F.col("p.name").alias("package"), F.posexplode("p.resources").alias("place", "r")).select("package", "r.format", "r.url", "place")


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The fixed table of sources."""
    return spark.createDataFrame(rows, SOURCE)


def source(registry_rows: DataFrame, key: str):
    """One registered source, or a KeyError."""
    row = registry_rows.where(F.col("source_id") == key).first()
    if row is None:
        raise KeyError(key)
    return row


def wide_points(spark: SparkSession, path: str, label: str = "municipality") -> DataFrame:
    """Points landed as Parquet with a WKB column: ``x, y`` (null where there is none) and the label."""
    from terrane.functions.geometry import wkb_point

    rows = spark.read.parquet(path)
    return rows.withColumn("_p", wkb_point("wkb")).select(*[c for c in rows.columns if c != "wkb"], F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A dataset, or no rows where it is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.format(kind).schema(schema).load(path)
