"""Polygons as grid cells of several sizes: inner cells without geometry, edge cells with the edges that count there.

A cell that no edge touches lies wholly inside or outside, which its centre decides; the largest such cells are
kept. A cell that edges touch is divided while it holds more than a few. It carries the edges that a ray
to the right can meet from a point in it: those that reach its rows and don't end left of it. So the exact
test there is the polygon's own, edge by edge, and the cover grows with the boundary, not with the area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

DIVIDE = 4
FEW_EDGES = 16
_MARGIN = 1e-9
_CELLS = 1024
_EDGES = ArrayType(ArrayType(ArrayType(StructType([StructField(c, DoubleType()) for c in ("x1", "y1", "x2", "y2")]))))


def sizes(cell: float) -> list[float]:
    return [cell * DIVIDE, cell, cell / DIVIDE]


def holds(edges: Column, x: Column, y: Column) -> Column:
    """Point in polygon over lists of edges: in a part's outer ring and in none of its holes; parts toggle."""

    def odd(ring):
        def toggles(parity, e):
            at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
            return parity != F.coalesce(((e["y1"] > y) != (e["y2"] > y)) & (x < at), F.lit(False))

        return F.aggregate(ring, F.lit(False), toggles)

    def of_part(parity, part):
        holes = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))
        return parity != F.coalesce(odd(F.get(part, F.lit(0))) & ~F.exists(holes, odd), F.lit(False))

    return F.coalesce(F.aggregate(edges, F.lit(False), of_part), F.lit(False))


class Outline:
    """The edges of one polygon: ends, part, ring (0 outside, then holes)."""

    def __init__(self, parts):
        import numpy as np
        import pyarrow.compute as pc

        n_rings = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        rings = parts.flatten()
        n_points = pc.list_value_length(rings).to_numpy(zero_copy_only=False).astype(np.int64)
        points = rings.flatten()
        x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in "xy")
        owner = np.repeat(np.arange(len(rings)), n_points)
        step = np.flatnonzero(owner[1:] == owner[:-1])
        self.ends = np.stack([x[step], y[step], x[step + 1], y[step + 1]])
        part = np.repeat(np.arange(len(parts)), n_rings)
        first = np.cumsum(n_rings) - n_rings
        self.part, self.ring = part[owner[step]], (np.arange(len(rings)) - first[part])[owner[step]]

    def box(self):
        x1, y1, x2, y2 = self.ends
        return min(x1.min(), x2.min()), min(y1.min(), y2.min()), max(x1.max(), x2.max()), max(y1.max(), y2.max())

    def reach(self, at, x0: float, y0: float, y1: float):
        """Edges that count in a cell: what ends left of it never does."""
        import numpy as np

        a, b, c, d = self.ends[:, at]
        return at[(np.maximum(b, d) >= y0) & (np.minimum(b, d) <= y1) & (np.maximum(a, c) >= x0)]

    def touched(self, at, x0: float, y0: float, x1: float, y1: float) -> bool:
        """Whether an edge may touch the cell: boxes meet, and not all corners lie on one side of its line."""
        import numpy as np

        a, b, c, d = self.ends[:, at]
        near = np.minimum(a, c) <= x1
        a, b, c, d = a[near], b[near], c[near], d[near]
        sides = np.stack([(c - a) * (y - b) - (d - b) * (x - a) for x in (x0, x1) for y in (y0, y1)])
        slack = (np.abs(c - a) + np.abs(d - b)) * _MARGIN
        return bool(((sides.min(axis=0) <= slack) & (sides.max(axis=0) >= -slack)).any())

    def holds(self, at, x: float, y: float) -> bool:
        import numpy as np

        a, b, c, d = self.ends[:, at]
        over = (b > y) != (d > y)
        at, a, b, c, d = at[over], a[over], b[over], c[over], d[over]
        at = at[x < (c - a) * (y - b) / (d - b) + a]
        inside = False
        for part in np.unique(self.part[at]):
            odd = np.bincount(self.ring[at[self.part[at] == part]]) & 1
            inside ^= bool(odd[0]) and not odd[1:].any()
        return inside

    def cells(self, steps: list[float], few: int):
        """(level, column, row, edges or None) of the cover."""
        import numpy as np

        if not self.ends.size:
            return
        west, south, east, north = self.box()
        every = np.arange(self.ends.shape[1])
        size = steps[0]
        todo = [(0, cx, cy, every) for cx in range(int(np.floor(west / size)), int(np.floor(east / size)) + 1) for cy in range(int(np.floor(south / size)), int(np.floor(north / size)) + 1)]
        while todo:
            level, cx, cy, at = todo.pop()
            size = steps[level]
            x0, y0, x1, y1 = cx * size - _MARGIN, cy * size - _MARGIN, (cx + 1) * size + _MARGIN, (cy + 1) * size + _MARGIN
            at = self.reach(at, x0, y0, y1)
            outer = np.unique(self.part[at[self.ring[at] == 0]])
            at = at[np.isin(self.part[at], outer)]  # without its outer ring a part holds nothing
            if not self.touched(at, x0, y0, x1, y1):
                if self.holds(at, (cx + 0.5) * size, (cy + 0.5) * size):
                    yield level, cx, cy, None
            elif len(at) > few and level + 1 < len(steps):
                todo += [(level + 1, cx * DIVIDE + i, cy * DIVIDE + j, at) for i in range(DIVIDE) for j in range(DIVIDE)]
            else:
                yield level, cx, cy, at


def _lists(found: list):
    """Edges of some cells as nested Arrow lists: parts, rings, edges; null for inner cells."""
    import numpy as np
    import pyarrow as pa

    parts, rings, edges, ends = [0], [0], [0], []
    for outline, at in found:
        if at is not None:
            ends.append(outline.ends[:, at])
            key = outline.part[at] * (outline.ring.max(initial=0) + 1) + outline.ring[at]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            edges += (edges[-1] + np.append(new[1:], len(at))).tolist()
            first = np.flatnonzero(np.diff(outline.part[at[new]], prepend=-1))
            rings += (rings[-1] + np.append(first[1:], len(new))).tolist()
            parts.append(parts[-1] + len(first))
        else:
            parts.append(parts[-1])
    ends = np.concatenate(ends, axis=1) if ends else np.zeros((4, 0))
    structs = pa.StructArray.from_arrays([pa.array(e) for e in ends], names=["x1", "y1", "x2", "y2"])
    inner = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs)
    inner = pa.ListArray.from_arrays(pa.array(rings, pa.int32()), inner)
    return pa.ListArray.from_arrays(pa.array(parts, pa.int32()), inner, mask=pa.array([at is None for _, at in found], pa.bool_()))


def polygon_cells(polygons: DataFrame, geom: str = "geom", cell: float = 0.5, few: int = FEW_EDGES) -> DataFrame:
    """Polygons without their geometry, once for each cell ``_level, _cx, _cy``, with ``_edges`` (null in inner cells).

    Polygons without points have no cells. A task holds the edges of one polygon at a time.
    """
    rest = [c for c in polygons.columns if c != geom]
    schema = StructType([*polygons.select(*rest).schema]).add("_level", "integer").add("_cx", "integer").add("_cy", "integer").add("_edges", _EDGES)
    steps = sizes(cell)

    def run(batches):
        import pyarrow as pa

        def block(batch, rows, cells, found):
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in range(len(rest))]
            columns += [pa.array([c[k] for c in cells], pa.int32()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*columns, _lists(found)], names=schema.names)

        for batch in batches:
            rows, cells, found = [], [], []
            for i in range(batch.num_rows):
                parts = batch.column(len(rest))[i].values
                outline = Outline(parts) if parts is not None and len(parts) else None
                for level, cx, cy, at in outline.cells(steps, few) if outline else ():
                    rows.append(i)
                    cells.append((level, cx, cy))
                    found.append((outline, at))
                    if len(rows) == _CELLS:
                        yield block(batch, rows, cells, found)
                        rows, cells, found = [], [], []
            if rows:
                yield block(batch, rows, cells, found)

    return polygons.select(*rest, F.col(f"{geom}.parts").alias("_parts")).mapInArrow(run, schema)
