"""What the operators of this subpackage share: written tables, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a written table of ids or hashes may be broadcast (at most about 40 bytes each).
BROADCAST_ROWS = 500_000
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[DataFrame]] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is named (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="terrane-shared-")
    return _LOCAL["root"]


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/terrane/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._terrane_path = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(out)
    return out


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing will read again."""
    path = getattr(df, "_terrane_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_all(spark: SparkSession) -> None:
    """Delete all tables that materialize() wrote in this application: once the last result is stored."""
    for df in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        release(df)


def sliced(batches, rows: int = 256):
    """Arrow batches of few rows: Spark bounds a batch's bytes, this what one step makes of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold_ascii(column):
    """Lower-case A-Z and nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(column, upper, upper.lower())


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``. Returns ``node, root``: each node that is not
    the smallest of its component, with that smallest node. Self-loops and repeated edges
    are ignored; no edges give no rows. Each step joins edges with a minimum for each node,
    so a node of high degree is a skewed join that adaptive execution splits, never a list.
    """

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    step = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    before = digest(step)
    while True:
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        if digest(large) == before and large.groupBy("u").count().where("count > 1").isEmpty():
            release(large)  # every node has one edge, to a node that has none below it
            out = step.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._terrane_path = step._terrane_path
            return out
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        before = digest(after)
        release(step)
        release(large)
        step = after


def tiled(keyed: DataFrame, spread: str, tile_rows: int) -> DataFrame:
    """Deal rows that share ``key`` into tiles of bounded size that together meet every pair.

    A key of ``n`` rows has ``c = ceil(n / tile_rows)`` chunks by the hash
    of ``spread``; tile (i, j) holds chunks i and j. Adds ``tile`` and ``chunk``; ``cross`` says
    that only pairs from different chunks count there.

    Rows exploded to keys look to Spark as small as the table that they come from, so the counts are what is broadcast, or nothing:
    those of all keys that have several rows (keys of one row go), or where these are many of the keys
    that have several chunks (keys of one row stay, as tiles of one row).
    """
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"))
    how = "inner"
    if sizes.count() > BROADCAST_ROWS:
        sizes, how = sizes.where(F.col("_n") > tile_rows), "left"
    few = how == "inner" or sizes.count() <= BROADCAST_ROWS
    rows = keyed.join(F.broadcast(sizes) if few else sizes.hint("merge"), "key", how)
    chunks = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(tile_rows)).cast("int")
    rows = rows.withColumn("_c", chunks).withColumn("chunk", F.pmod(F.xxhash64(F.col(spread)), F.col("_c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_c") - 1))
    rows = rows.withColumn("_o", other)
    low, high = F.least("chunk", "_o"), F.greatest("chunk", "_o")
    rows = rows.withColumn("tile", (low.cast("long") * F.col("_c") + high).cast("long")).withColumn("cross", low != high)
    rows = rows.drop("_n", "_c", "_o")
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile")


def group_batches(batches, keys: list[str], rows: int = 50_000):
    """Pandas frames of whole groups from sorted Arrow batches: a group is never cut."""
    import pandas as pd

    held: list = []
    count = 0
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        held.append(frame)
        count += len(frame)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else frame
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = int(len(frame) - last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held = [frame.iloc[cut:]]
        count = len(held[0])
    if held:
        frame = pd.concat(held, ignore_index=True)
        if len(frame):
            yield frame


def group_starts(frame, keys: list[str]):
    """Start of each run of equal keys, and the end."""
    import numpy as np

    new = np.zeros(len(frame), dtype=bool)
    new[0] = True
    for key in keys:
        column = frame[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), len(frame))
