"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrane.functions import geometry as G

FEATURES = "struct<features:array<struct<properties:map<string,string>,geometry:string>>>"
# How deep each kind nests its coordinates.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def parsed_geometry(text):
    """A geometry of any kind from its JSON; null for collections and what can't be read."""
    kind = F.get_json_object(text, "$.type")
    coordinates = F.get_json_object(text, "$.coordinates")
    pair = lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))
    line = lambda r: F.transform(r, pair)
    parse = lambda depth: F.from_json(coordinates, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(pair(parse(0))))))
        .when(kind == "MultiPoint", F.transform(parse(1), lambda p: F.array(F.array(pair(p)))))
        .when(kind == "LineString", F.array(F.array(line(parse(1)))))
        .when(kind == "MultiLineString", F.transform(parse(2), lambda r: F.array(line(r))))
        .when(kind == "Polygon", F.array(F.transform(parse(2), line)))
        .when(kind == "MultiPolygon", F.transform(parse(3), lambda p: F.transform(p, line)))
    )
    return F.when(parts.isNotNull(), F.struct(kind.alias("kind"), parts.alias("parts")))


def read(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """``ord, properties, geom`` of the features with a readable geometry.

    A byte-order mark is skipped; geometry collections are left out; a missing file gives no rows.
    """
    empty = f"ord int, properties map<string,string>, geom {G.GEOMETRY}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], empty)
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    rows = text.select(F.posexplode(F.from_json("value", FEATURES)["features"]).alias("ord", "f"))
    return rows.select("ord", "f.properties", parsed_geometry(F.col("f.geometry")).alias("geom")).where("geom is not null")


def named(spark: SparkSession, path: str, field: str, part: str) -> DataFrame:
    """The first feature whose field contains a text."""
    return read(spark, path).where(F.contains(F.col("properties")[field], F.lit(part))).orderBy("ord").limit(1)


def geometry_json(geom):
    """A geometry as GeoJSON text."""
    pair = lambda p: F.array(p["x"], p["y"])
    line = lambda r: F.transform(r, pair)
    kind, parts = geom["kind"], geom["parts"]
    coordinates = (
        F.when(kind == "Point", F.to_json(pair(F.get(F.get(F.get(parts, F.lit(0)), F.lit(0)), F.lit(0)))))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: pair(F.get(F.get(p, F.lit(0)), F.lit(0))))))
        .when(kind == "LineString", F.to_json(line(F.get(F.get(parts, F.lit(0)), F.lit(0)))))
        .when(kind == "MultiLineString", F.to_json(F.transform(parts, lambda p: line(F.get(p, F.lit(0))))))
        .when(kind == "Polygon", F.to_json(F.transform(F.get(parts, F.lit(0)), line)))
        .otherwise(F.to_json(F.transform(parts, lambda p: F.transform(p, line))))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))


def feature_json(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One feature a row as text (``value``); empty properties are left out, zero and false stay."""
    from terrane.functions.values import drop_empty

    names = [f for f in df.schema.fields if f.name != geom]
    kept = [drop_empty(F.col(f.name), f.dataType.typeName()).alias(f.name) for f in names]
    properties = F.to_json(F.struct(*kept)) if kept else F.lit("{}")
    body = F.coalesce(geometry_json(F.col(geom)), F.lit("null"))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), body, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write(df: DataFrame, path: str, metadata: dict | None = None, geom: str = "geom") -> None:
    """A layer as newline-delimited features beside a one-line header; empty layers are written too.

    Each task writes its own part, so a layer of any size is written without gathering it.
    """
    import json

    spark = df.sparkSession
    feature_json(df, geom).write.mode("overwrite").text(f"{path}/features")
    header = {"type": "FeatureCollection", **(metadata or {})}
    spark.createDataFrame([(json.dumps(header, ensure_ascii=False, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/header")


def collection(df: DataFrame, metadata: dict | None = None, geom: str = "geom") -> DataFrame:
    """One FeatureCollection as text, for layers small enough to be one document."""
    import json

    extra = json.dumps(metadata or {}, ensure_ascii=False)[1:-1]
    head = F.lit('{"type":"FeatureCollection"' + ("," + extra if extra else "") + ',"features":[')
    return feature_json(df, geom).agg(F.concat(head, F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]}")).alias("value"))


def empty(spark: SparkSession, like: StructType) -> DataFrame:
    return spark.createDataFrame([], like)
