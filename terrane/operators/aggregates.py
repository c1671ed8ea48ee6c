"""Counts and tallies whose zero, null and tie rules matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_kept_counts(rows: DataFrame, vocabulary: DataFrame, key: str, out: str = "n") -> DataFrame:
    """A count for each member of a vocabulary, also those that never occur."""
    return vocabulary.join(rows.groupBy(key).agg(F.count("*").alias(out)), key, "left").fillna(0, [out])


def label_tally(rows: DataFrame, labels: str, key: str | None = None) -> DataFrame:
    """Rows for each label (one row adds to all of its labels); the unlabelled as ``uncategorised``."""
    by = [key] if key else []
    found = F.when(F.size(labels) > 0, F.col(labels)).otherwise(F.array(F.lit("uncategorised")))
    return rows.select(*by, F.explode(found).alias("label")).groupBy(*by, "label").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key its values by falling frequency, as an array of (value, n)."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    by = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))  # one entry for each distinct value
    return counted.groupBy(key).agg(F.transform(by, lambda e: F.struct(e["v"].alias("value"), (-e["m"]).alias("n"))).alias("histogram"))


def unpivot_rounds(rows: DataFrame, ids: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide rounds to long: ``round, assessed, dated`` for each round's pair of columns."""
    each = F.array(*[F.struct(F.lit(n).alias("round"), F.col(a).alias("assessed"), F.col(d).alias("dated")) for n, (a, d) in pairs.items()])
    return rows.select(*ids, F.explode(each).alias("r")).select(*ids, "r.round", "r.assessed", "r.dated")


def round_summary(long: DataFrame) -> DataFrame:
    """For each round: how many were assessed, the most frequent date (the earliest of ties), and whether dates are mixed."""
    assessed = long.where("assessed is not null")
    dates = assessed.where("dated is not null").groupBy("round", "dated").agg(F.count("*").alias("n"))
    top = dates.groupBy("round").agg(F.min(F.struct((-F.col("n")).alias("m"), "dated")).alias("t"), (F.count("*") > 1).alias("mixed"))
    counted = long.groupBy("round").agg(F.count("assessed").alias("n"))
    return counted.join(top, "round", "left").select("round", "n", F.col("t.dated").alias("dated"), F.coalesce("mixed", F.lit(False)).alias("mixed"))


def round_timeline(long: DataFrame) -> DataFrame:
    """Rounds that have a date, by date."""
    return round_summary(long).where("dated is not null").orderBy("dated", "round")


def shares(rows: DataFrame, key: str, value: Column, digits: int = 2) -> DataFrame:
    """Sum by key and its share of the whole; the whole is one row's window over the sums."""
    summed = rows.groupBy(key).agg(F.sum(value).alias("total"))
    whole = summed.agg(F.sum("total").alias("whole"))
    joined = summed.join(F.broadcast(whole), F.lit(True), "left")  # one row
    return joined.select(key, "total", F.round(F.try_divide(F.col("total") * 100, "whole"), digits).alias("pct"))


def first_present(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first non-blank value of each key by an order."""
    return rows.where(F.nullif(F.trim(value), F.lit("")).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def falls(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows at which a series that may only rise falls."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("before", before).where(F.col("before") > F.col(value))


def conserved(rows: DataFrame, flag: Column) -> DataFrame:
    """Total, kept and withheld; nothing is lost between them."""
    kept = F.coalesce(flag, F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("withheld"))


def top_rows(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def reached(stage: Column, begun: Column, day: Column) -> Column:
    """Aggregate of events: the highest stage begun by a day, whatever ended since; null if none."""
    return F.max(F.when(begun <= day, stage))


def standing(stage: Column, begun: Column, ended: Column, day: Column) -> Column:
    """Aggregate of events: the highest stage whose interval holds the day; an open end holds on."""
    return F.max(F.when((begun <= day) & F.coalesce(ended >= day, F.lit(True)), stage))
