"""Spark sessions and the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "6g") -> SparkSession:
    """A session on this machine, for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("terrane")
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
        "spark.driver.memory": memory,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the named Parquet tables under a data folder; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
