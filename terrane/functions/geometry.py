"""Geometry as nested arrays: parts hold rings, rings hold points ``struct<x, y>``.

Column expressions throughout; line simplification and WKB, which are sequential, are Arrow functions.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrane.config import SETTINGS

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
GEOMETRY = f"struct<kind:string,parts:array<array<{RING}>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring, counter-clockwise."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))


def _steps(ring: Column) -> Column:
    """Indexes of a ring's edges; none for fewer than two points."""
    return F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, v: a + v)


def ring_crossings(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right of the point crosses the closed ring an odd number of times.

    Edges are half-open upward, so a vertex counts once; x must be strictly left of the crossing.
    """

    def toggles(odd, i):
        a, b = F.get(ring, i), F.get(ring, i + 1)
        straddles = (a["y"] > y) != (b["y"] > y)
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return odd != F.coalesce(straddles & (x < at), F.lit(False))

    return F.aggregate(_steps(ring), F.lit(False), toggles)


def contains(parts: Column, x: Column, y: Column) -> Column:
    """Point in polygon: in a part's outer ring and in none of its holes; parts toggle."""

    def toggles(odd, part):
        holes = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))
        inside = ring_crossings(F.get(part, F.lit(0)), x, y) & ~F.exists(holes, lambda h: ring_crossings(h, x, y))
        return odd != F.coalesce(inside, F.lit(False))

    return F.coalesce(F.aggregate(parts, F.lit(False), toggles), F.lit(False))


def vertices(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def vertex_count(parts: Column) -> Column:
    return F.size(vertices(parts))


def bounds(parts: Column) -> Column:
    """Struct (x0, y0, x1, y1); null members without vertices."""
    xs, ys = F.transform(vertices(parts), lambda p: p["x"]), F.transform(vertices(parts), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive counter-clockwise."""
    return _sum(F.transform(_steps(ring), lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])) / 2


def is_clockwise(ring: Column) -> Column:
    return signed_area(ring) < 0


def planar_area(parts: Column) -> Column:
    """Outer rings add, holes subtract, whatever way they turn."""

    def of_part(part):
        rings = F.transform(part, lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * F.abs(signed_area(r)))
        return _sum(rings)

    return _sum(F.transform(parts, of_part))


def ring_center(parts: Column) -> Column:
    """Mean of the vertices, the closing one included, of the outer ring of the part with the largest box."""

    def box(part):
        b = bounds(F.array(part))
        return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])

    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-box(p)).alias("size"), i.alias("i"))))
    ring = F.get(F.get(parts, F.get(ranked, F.lit(0))["i"]), F.lit(0))
    n = F.size(ring).cast("double")
    return F.struct(
        F.try_divide(_sum(F.transform(ring, lambda p: p["x"])), n).alias("x"), F.try_divide(_sum(F.transform(ring, lambda p: p["y"])), n).alias("y")
    )


def closed_rings(parts: Column) -> Column:
    """All rings have four points or more and end where they begin."""
    return F.forall(F.flatten(parts), lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.try_element_at(r, F.lit(-1))))


def rounded(parts: Column, digits: int = SETTINGS.coordinate_digits) -> Column:
    return F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: point(F.round(v["x"], digits), F.round(v["y"], digits)))))


def metres(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance on a plane scaled for the reference latitude."""
    per = SETTINGS.metres_per_degree
    return F.hypot((ax - bx) * (math.cos(math.radians(SETTINGS.reference_latitude)) * per), (ay - by) * per)


def block_cell(value: Column, size: float = SETTINGS.block_cell_deg) -> Column:
    """Grid cell of a coordinate, truncated toward zero."""
    return (value / F.lit(size)).cast("int")


def own_cell(rows: DataFrame, x: str, y: str, size: float = SETTINGS.block_cell_deg) -> DataFrame:
    """Rows with the grid cell ``_cx, _cy`` that they lie in."""
    return rows.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})


def around(rows: DataFrame, x: str, y: str, size: float = SETTINGS.block_cell_deg) -> DataFrame:
    """Rows once for each of the nine cells around them: what lies within a cell's width meets them there."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dealt = own_cell(rows, x, y, size).withColumn("_s", F.explode(steps))
    return dealt.withColumns({"_cx": F.col("_cx") + F.col("_s.i"), "_cy": F.col("_cy") + F.col("_s.j")}).drop("_s")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def edges(features: DataFrame, geom: str = "geom", *keep: str) -> DataFrame:
    """One row for each edge: the kept columns, part, ring, seq and both ends."""
    rings = features.select(*keep, F.posexplode(F.col(f"{geom}.parts")).alias("part", "rings"))
    rings = rings.select(*keep, "part", F.posexplode("rings").alias("ring", "points"))
    steps = rings.select(*keep, "part", "ring", "points", F.explode(_steps(F.col("points"))).alias("seq"))
    a, b = F.get("points", F.col("seq")), F.get("points", F.col("seq") + 1)
    return steps.select(*keep, "part", "ring", "seq", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def thin_line(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on a stack: ends stay, and each span's farthest point beyond the tolerance."""
    if len(points) < 3:
        return list(points)
    keep = {0, len(points) - 1}
    spans = [(0, len(points) - 1)]
    while spans:
        lo, hi = spans.pop()
        (ax, ay), (bx, by) = points[lo], points[hi]
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        worst, place = tolerance, -1
        for k in range(lo + 1, hi):
            px, py = points[k]
            t = min(1.0, max(0.0, ((px - ax) * dx + (py - ay) * dy) / length)) if length else 0.0
            off = math.hypot(px - ax - t * dx, py - ay - t * dy)
            if off > worst:
                worst, place = off, k
        if place >= 0:
            keep.add(place)
            spans += [(lo, place), (place, hi)]
    return [points[k] for k in sorted(keep)]


def simplify(parts: Column, tolerance: float, polygon: bool = True) -> Column:
    """Simplified parts from and to the same nested type; rings that would fall below four points stay."""

    def thin_ring(ring):
        line = [(p["x"], p["y"]) for p in ring]
        thin = thin_line(line, tolerance)
        if polygon and thin and thin[0] != thin[-1]:
            thin.append(thin[0])
        if polygon and len(thin) < 4:
            thin = line
        return [{"x": x, "y": y} for x, y in thin]

    @F.arrow_udf(f"array<array<{RING}>>")
    def run(column: pa.Array) -> pa.Array:
        out = [None if parts is None else [[thin_ring(ring) for ring in part] for part in parts] for parts in column.to_pylist()]
        return pa.array(out, pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))

    return run(parts)


@F.pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def wkb_point(wkb: pd.Series) -> pd.DataFrame:
    """A WKB point of either byte order; null coordinates for null or anything else."""
    none = (None, None)

    def read(blob):
        if blob is None or len(blob) < 21:
            return none
        order = "<" if blob[0] == 1 else ">"
        (kind,) = struct.unpack_from(f"{order}I", blob, 1)
        skip = 4 if kind & 0x20000000 else 0
        return struct.unpack_from(f"{order}dd", blob, 5 + skip) if kind & 0xFF == 1 and len(blob) >= 21 + skip else none

    found = [read(b) for b in wkb]
    return pd.DataFrame({"x": [p[0] for p in found], "y": [p[1] for p in found]})
