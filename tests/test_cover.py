"""The cell cover of polygons against the exact test over whole geometries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import geometry as G
from terrane.operators import cover, spatial


def star(rng, x, y, size, n):
    ring = [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*ring, ring[0]]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def shapes(rng):
    out = [[[star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(0.1, 4), rng.randrange(3, 60))]] for _ in range(8)]
    out += [
        [[box(-4, -4, 4, 4), box(-2, -2, 2, 2)]],  # a hole as large as many cells
        [[star(rng, 0, 0, 5, 90), star(rng, 0.2, 0.1, 1.2, 30), box(0, 0, 3, 0.5)]],  # holes that overlap
        [[box(0, 0, 2, 2)], [box(1, 1, 3, 3)]],  # parts that overlap toggle
        [[box(-0.5, -0.5, 0.5, 0.5)]],  # edges on cell borders
        [[box(-3, 3, 3, 3.001)], [box(8, 8, 8.0001, 8.0001), box(7, 7, 9, 9)]],
        [[star(rng, 0, 0, 6, 4), star(rng, 0, 0, 0.01, 5)]], [[[(0.0, 0.0), (5.0, 5.0), (5.0, 5.0), (0.0, 0.0)]]], [[[(1.0, 1.0)]]], [[[]]], [],
    ]
    return out


@pytest.mark.parametrize("cell,few", [(0.5, 16), (0.5, 0), (0.3, 4), (4.0, 16)])
def test_cover_finds_what_whole_geometries_hold(spark, cell, few, monkeypatch):
    rng = random.Random(7)
    rows = [(k, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts]) for k, parts in enumerate(shapes(rng))] + [(98, None)]
    polygons = spark.createDataFrame(rows, f"fid int, parts array<array<{G.RING}>>")
    polygons = polygons.select("fid", F.when(F.col("parts").isNotNull(), G.geometry("MultiPolygon", F.col("parts"))).alias("geom"))
    places = [(rng.uniform(-7, 9), rng.uniform(-7, 9)) for _ in range(500)] + [(x / 2, y / 2) for x in range(-9, 9) for y in range(-9, 9)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)] + [(-1, None, 1.0), (-2, float("nan"), 1.0)], "pid int, x double, y double")
    want = points.crossJoin(polygons.where("geom is not null")).where(G.contains(F.col("geom.parts"), F.col("x"), F.col("y")) & ~F.isnan("x")).select("pid", "fid")
    cells = cover.polygon_cells(polygons, cell=cell, few=few).cache()
    size = dict(enumerate(cover.sizes(cell)))
    keyed = points.where("x is not null and not isnan(x)").crossJoin(spark.createDataFrame([(k, s) for k, s in size.items()], "_level int, _size double"))
    keyed = keyed.withColumns({"_cx": F.floor(F.col("x") / F.col("_size")).cast("int"), "_cy": F.floor(F.col("y") / F.col("_size")).cast("int")})
    got = keyed.join(cells, ["_level", "_cx", "_cy"]).where(F.col("_edges").isNull() | cover.holds(F.col("_edges"), F.col("x"), F.col("y"))).select("pid", "fid")
    expected = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 500
    if (cell, few) == (0.5, 16):
        assert sorted((r.pid, r.fid) for r in spatial.matches(points, polygons).collect()) == expected
        assert cells.where("_edges is null").count() > 50


def test_edges_sent_grow_with_the_boundary(spark):
    def sent(n, size):
        ring = [(10 + size * math.cos(2 * math.pi * k / n), 10 + size * math.sin(2 * math.pi * k / n)) for k in range(n)]
        rows = spark.createDataFrame([(1, [[[*ring, ring[0]]]])], f"fid int, parts array<array<{G.RING}>>")
        cells = cover.polygon_cells(rows.select("fid", G.geometry("Polygon", F.col("parts")).alias("geom")))
        edges = F.coalesce(F.size(F.flatten(F.flatten("_edges"))), F.lit(0))
        return cells.agg(F.sum(edges), F.count("*")).first()

    small, large = sent(2000, 1.0), sent(8000, 8.0)
    # eight times the radius, four times the points: the area is 64 times as large
    assert large[0] < 12 * small[0] and large[1] < 20 * small[1]
    assert large[0] < 12 * 8000


def test_no_polygons(spark):
    none = spark.createDataFrame([], f"fid int, geom {G.GEOMETRY}")
    assert cover.polygon_cells(none).count() == 0
    assert spatial.outside(spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double"), none, "pid").count() == 1
