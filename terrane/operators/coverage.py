"""Overlap-aware area: a sparse raster of layer bits, and the union for every subset of layers.

A cell belongs to a layer when its centre does (even-odd over all rings of a part). Edges become
the rows that they cross, crossings of a row are paired in order, and pairs become spans of cells.
A sweep over the ends of a row's spans gives runs of cells with one combination of layers, so
rows grow with boundaries: neither the grid's size nor a covered area costs anything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.config import SETTINGS
from terrane.functions import geometry as G


@dataclass(frozen=True)
class Grid:
    """Cells of about ``cell_m`` metres over a box of degrees."""

    west: float
    south: float
    east: float
    north: float
    cell_m: float = SETTINGS.coverage_cell_m

    @property
    def lat_step(self) -> float:
        return self.cell_m / SETTINGS.metres_per_degree

    @property
    def lon_step(self) -> float:
        middle = math.radians((self.south + self.north) / 2)
        return self.cell_m / (SETTINGS.metres_per_degree * math.cos(middle))

    @property
    def rows(self) -> int:
        return int((self.north - self.south) / self.lat_step) + 1

    @property
    def columns(self) -> int:
        return int((self.east - self.west) / self.lon_step) + 1

    def row_area(self, row: Column) -> Column:
        """Square metres of one cell of a row, at the latitude of the row's centre."""
        per = SETTINGS.metres_per_degree
        lat = self.south + (row + 0.5) * self.lat_step
        return F.lit(self.lat_step * per) * F.lit(self.lon_step * per) * F.cos(F.radians(lat))


def grid_over(extent: DataFrame, geom: str = "geom", cell_m: float = SETTINGS.coverage_cell_m) -> Grid:
    """The grid over the box of a layer; four numbers come to the driver."""
    boxes = extent.select(G.bounds(F.col(f"{geom}.parts")).alias("b"))
    row = boxes.agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).first()
    if row[0] is None:
        raise ValueError("the extent has no geometry")
    return Grid(*map(float, row), cell_m=cell_m)


def burn(features: DataFrame, slot: Column, grid: Grid, fid: str = "fid", geom: str = "geom") -> DataFrame:
    """Spans ``row, first, last, slot`` of cells that the features cover."""
    lines = G.edges(features.withColumn("_slot", slot), geom, fid, "_slot").where("y1 <> y2")

    def row_of(y: Column) -> Column:
        return (y - grid.south) / grid.lat_step - 0.5

    low = F.greatest(F.floor(row_of(F.least("y1", "y2"))).cast("long"), F.lit(0).cast("long"))
    high = F.least(F.ceil(row_of(F.greatest("y1", "y2"))).cast("long"), F.lit(grid.rows - 1).cast("long"))
    lines = lines.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    lines = lines.withColumn("row", F.explode(F.sequence("_low", "_high")))
    y = grid.south + (F.col("row") + 0.5) * grid.lat_step
    lines = lines.withColumn("_y", y).where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    at = F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = lines.select(fid, "_slot", "part", "row", ((at - grid.west) / grid.lon_step).alias("c"))
    order = Window.partitionBy(fid, "part", "row").orderBy("c")
    crossings = crossings.withColumn("_k", F.row_number().over(order)).withColumn("_end", F.lead("c").over(order))
    spans = crossings.where("_k % 2 = 1 and _end is not null")  # an odd last crossing has no partner
    first = F.greatest(F.ceil(F.col("c") - 0.5).cast("long"), F.lit(0).cast("long"))
    last = F.least(F.floor(F.col("_end") - 0.5).cast("long"), F.lit(grid.columns - 1).cast("long"))
    return spans.select("row", first.alias("first"), last.alias("last"), F.col("_slot").alias("slot")).where("first <= last")


def runs(spans: DataFrame, slots: int) -> DataFrame:
    """``row, n, c0, c1, ...``: runs of cells of a row and how many spans of each slot lie over them.

    Ends at one place are summed first, so a row of the grid has at most one end for each of its columns.
    """
    begin, end = (F.struct(at.alias("at"), F.lit(d).alias("d")) for at, d in ((F.col("first"), 1), (F.col("last") + 1, -1)))
    ends = spans.select("row", "slot", F.explode(F.array(begin, end)).alias("e"))
    here = [F.sum(F.when(F.col("slot") == k, F.col("e.d")).otherwise(0)).alias(f"c{k}") for k in range(slots)]
    ends = ends.groupBy("row", F.col("e.at").alias("at")).agg(*here)
    order = Window.partitionBy("row").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.select("row", (F.lead("at").over(order) - F.col("at")).alias("n"), *[F.sum(f"c{k}").over(so_far).alias(f"c{k}") for k in range(slots)])
    return swept.where("n is not null")


def _mask(counts: list[Column]) -> Column:
    """Bit k where the k-th count isn't zero."""
    out = F.lit(0).cast("long")
    for k, count in enumerate(counts):
        out = out.bitwiseOR(F.when(count > 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def masks(layers: list[DataFrame], grid: Grid, geom: str = "geom") -> DataFrame:
    """``row, mask, n``: how many cells of a row have each combination of layers; layer k has bit k."""
    spans = None
    for k, layer in enumerate(layers):
        part = burn(layer, F.lit(k), grid, geom=geom)
        spans = part if spans is None else spans.unionByName(part)
    swept = runs(spans, len(layers)).select("row", "n", _mask([F.col(f"c{k}") for k in range(len(layers))]).alias("mask"))
    return swept.where("mask <> 0").groupBy("row", "mask").agg(F.sum("n").alias("n"))


def layer_areas(histogram: DataFrame, grid: Grid) -> DataFrame:
    """``mask, km2`` for each combination of layers."""
    area = F.sum(F.col("n") * grid.row_area(F.col("row"))) / 1e6
    return histogram.groupBy("mask").agg(area.alias("km2"))


def union_areas(spark: SparkSession, areas: DataFrame, names: list[str], denominator: int = 0, clip: bool = False) -> DataFrame:
    """Area of the union of every non-empty subset of measures: ``subset_key, wanted, km2, pct``.

    ``areas`` is one row for each combination, so at most ``2**layers`` rows. Bit ``denominator``
    is what shares are of; with ``clip`` only cells inside it count.
    """
    measures = [k for k in range(len(names)) if k != denominator]
    rows = []
    for chosen in range(1, 1 << len(measures)):
        bits = [m for i, m in enumerate(measures) if chosen >> i & 1]
        rows.append(("+".join(sorted(names[m] for m in bits)), sum(1 << m for m in bits)))
    subsets = spark.createDataFrame(rows, "subset_key string, wanted long")
    bit = 1 << denominator
    whole = areas.agg(F.sum(F.when(F.col("mask").bitwiseAND(bit) != 0, F.col("km2")).otherwise(0.0)).alias("whole"))
    inside = F.col("mask").bitwiseAND(bit) != 0 if clip else F.lit(True)
    taken = F.when((F.col("mask").bitwiseAND(F.col("wanted")) != 0) & inside, F.col("km2")).otherwise(0.0)
    # one row for each combination of layers and one for each subset: both bounded by the layers
    paired = subsets.join(F.broadcast(areas), F.lit(True), "left").groupBy("subset_key", "wanted").agg(F.coalesce(F.sum(taken), F.lit(0.0)).alias("km2"))
    shared = paired.join(F.broadcast(whole), F.lit(True), "left")
    return shared.select("subset_key", "wanted", "km2", F.try_divide(F.col("km2") * 100, "whole").alias("pct"))


def coverage(layers: dict[str, DataFrame], extent: str, cell_m: float = SETTINGS.coverage_cell_m, clip: bool = False) -> DataFrame:
    """Union areas of all subsets of the layers but the extent, on the grid of the extent."""
    names = [extent, *[n for n in layers if n != extent]]
    grid = grid_over(layers[extent], cell_m=cell_m)
    histogram = masks([layers[n] for n in names], grid)
    return union_areas(layers[extent].sparkSession, layer_areas(histogram, grid), names, clip=clip)


def timeline(layers: dict[str, DataFrame], extent: str, years: list[int], day: str = "dated", cell_m: float = SETTINGS.coverage_cell_m, today: bool = True) -> DataFrame:
    """Union areas by the end of each year, from dated features only; ``today`` has all features.

    Every layer is burned once. A span's slot says its layer and the first year asked for that has it, so one
    sweep of a row gives the combination of layers in every year.
    """
    names = [extent, *[n for n in layers if n != extent]]
    grid = grid_over(layers[extent], cell_m=cell_m)
    asked = [*years, *([None] if today else [])]
    steps = sorted(set(years))
    width = len(steps) + 1  # the last one: undated, or later than all years
    spans = None
    for k, name in enumerate(names):
        year = F.year(day) if k else F.lit(steps[0] if steps else 0)  # the extent counts in every year
        step = F.lit(len(steps))
        for j in reversed(range(len(steps))):
            step = F.when(year <= steps[j], j).otherwise(step)
        part = burn(layers[name], step + k * width, grid)
        spans = part if spans is None else spans.unionByName(part)
    swept = runs(spans, len(names) * width)

    def in_force(upto: int) -> Column:
        return _mask([sum((F.col(f"c{k * width + j}") for j in range(1, upto + 1)), F.col(f"c{k * width}")) for k in range(len(names))])

    each = F.array(*[F.struct(F.lit(i).alias("i"), in_force(len(steps) if y is None else steps.index(y)).alias("mask")) for i, y in enumerate(asked)])
    counted = swept.select("row", "n", F.explode(each).alias("e")).where("e.mask <> 0").groupBy("row", "e.i", "e.mask").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("i", "mask").agg((F.sum(F.col("n") * grid.row_area(F.col("row"))) / 1e6).alias("km2"))  # 2**layers rows a year
    out = None
    for i, year in enumerate(asked):
        part = union_areas(layers[extent].sparkSession, counted.where(F.col("i") == i).select("mask", "km2"), names)
        part = part.withColumn("year", F.lit(year).cast("int")).withColumn("dated_only", F.lit(year is not None))
        out = part if out is None else out.unionByName(part)
    return out


def subset_key(ids: Column) -> Column:
    """The one key of a selection of measures, in whatever order they were chosen."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), "+")
