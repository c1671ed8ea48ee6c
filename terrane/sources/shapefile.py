"""Zipped shapefiles as a data source: one archive is read by many tasks, each a range of its records.

The plan reads the archive's ``.shx`` index, 8 bytes for a record, and cuts the ``.shp`` into ranges of about
``SPLIT_BYTES``; a task seeks to its range there and to the same records of the ``.dbf``, whose records have one
length. Stored members are read from that place on. Deflated ones are inflated up to it and thrown away
piece by piece: a member has 2 GB at most by its format, so no task does more than that, and none holds
more than a batch of rows. Only asked attributes are decoded, and records whose own box lies outside a
given box are passed over before their points are.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from terrane.functions import crs
from terrane.functions import geometry as G

BOX = ("x0", "y0", "x1", "y1")
SCHEMA = f"ord int, attributes map<string,string>, geom {G.GEOMETRY}, source_crs string, " + ", ".join(f"{c} double" for c in BOX)
SPLIT_BYTES = 16 << 20
_ROWS = 256
_POINT, _LINE, _POLYGON, _MULTIPOINT = 1, 3, 5, 8


def _rings(body: bytes) -> list[list[tuple[float, float]]]:
    n_parts, n_points = struct.unpack_from("<ii", body, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", body, 44), n_points]
    numbers = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
    points = list(zip(numbers[::2], numbers[1::2]))
    return [points[a:b] for a, b in zip(starts, starts[1:])]


def turns_right(ring: list[tuple[float, float]]) -> bool:
    """Clockwise, by the sum over the edges."""
    return sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, ring[1:])) > 0


def polygons_of(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Clockwise rings open a polygon, others are holes of the one before; the first always opens."""
    parts: list[list] = []
    for ring in rings:
        if len(ring) < 4:
            continue
        if not parts or turns_right(ring):
            parts.append([ring])
        else:
            parts[-1].append(ring)
    return parts


def shape(body: bytes) -> tuple[str, list] | None:
    """(kind, parts) of one record; None for null shapes."""
    (kind,) = struct.unpack_from("<i", body, 0)
    kind = kind % 10 if kind > 10 else kind  # with Z or M values, which aren't read
    if kind == 0:
        return None
    if kind == _POINT:
        return "Point", [[[struct.unpack_from("<dd", body, 4)]]]
    if kind == _MULTIPOINT:
        (n,) = struct.unpack_from("<i", body, 36)
        numbers = struct.unpack_from(f"<{2 * n}d", body, 40)
        return "MultiPoint", [[[p]] for p in zip(numbers[::2], numbers[1::2])]
    if kind == _LINE:
        lines = [r for r in _rings(body) if len(r) > 1]
        return ("LineString" if len(lines) == 1 else "MultiLineString"), [[r] for r in lines]
    if kind == _POLYGON:
        parts = polygons_of(_rings(body))
        return ("Polygon" if len(parts) == 1 else "MultiPolygon"), parts
    raise ValueError(f"shape type {kind} isn't read")


def box_of(body: bytes) -> tuple[float, float, float, float] | None:
    """The box that a record states itself, without its points; None for null shapes."""
    (kind,) = struct.unpack_from("<i", body, 0)
    if kind == 0:
        return None
    if kind % 10 == _POINT:
        x, y = struct.unpack_from("<dd", body, 4)
        return x, y, x, y
    return struct.unpack_from("<4d", body, 4)


def apart(box: tuple, limits: dict[str, tuple[float, float]]) -> bool:
    """Whether a box fails one of the limits: for each side the smallest and largest value that it may have."""
    return any(not low <= v <= high for v, (low, high) in ((box[BOX.index(c)], r) for c, r in limits.items()))


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    begin: int
    width: int

    def value(self, record: bytes) -> str | None:
        """Dates as ISO, numbers and texts as trimmed text, blanks as None."""
        raw = record[self.begin : self.begin + self.width].decode("utf-8", "replace").strip("\0 ")
        if self.kind == "D" and raw:
            try:
                raw = date(int(raw[:4]), int(raw[4:6]), int(raw[6:8])).isoformat()
            except ValueError:
                raw = ""
        return raw or None


class Layer:
    """One layer of an archive; names of members compare without case or folders.

    ``opened`` gives the archive's file anew: members that are read side by side need one each, since
    handles of one archive seek from each other's places.
    """

    def __init__(self, opened: Callable, base: str):
        self.opened, self.files = opened, {}
        self.zip = zipfile.ZipFile(opened())
        for name in self.zip.namelist():
            stem, _, extension = name.rsplit("/", 1)[-1].rpartition(".")
            if stem.lower() == base.lower():
                self.files[extension.lower()] = name

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.zip.close()

    def text(self, extension: str) -> str | None:
        return self.zip.read(self.files[extension]).decode("utf-8", "replace") if extension in self.files else None

    def ranges(self, split_bytes: int) -> list[tuple[int, int | None, int]]:
        """(first record, end, its place in the .shp) of each task; one task without an index."""
        if "shx" not in self.files:
            return [(0, None, 100)]
        out, first, begin, k = [], 0, None, 0
        with self.zip.open(self.files["shx"]) as index:
            index.read(100)
            while block := index.read(8 * 8192):
                for at in range(0, len(block) - 7, 8):
                    place = 2 * struct.unpack_from(">i", block, at)[0]
                    begin = place if begin is None else begin
                    if place - begin >= split_bytes:
                        out.append((first, k, begin))
                        first, begin = k, place
                    k += 1
        return [*out, (first, k, begin)] if k else []

    def fields(self, columns: list[str] | None):
        """(fields asked for, length of the head, length of a record, number of records) of the .dbf."""
        with self.zip.open(self.files["dbf"]) as rows:
            start = rows.read(32)
            n, head, size = struct.unpack_from("<IHH", start, 4)
            block = rows.read(head - 32)
        found, place, at = [], 1, 0
        while at < len(block) and block[at] != 0x0D:
            name, width = block[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), block[at + 16]
            if columns is None or name in columns:
                found.append(Field(name, chr(block[at + 11]), place, width))
            place, at = place + width, at + 32
        return found, head, size, n

    def records(self, first: int, end: int | None, place: int, columns: list[str] | None, limits: dict) -> Iterator[tuple]:
        """(ord, attributes, kind, parts, box) of the records of a range that aren't null."""
        fields, head, size, n = self.fields(columns) if "dbf" in self.files else ([], 0, 0, 0)
        beside = zipfile.ZipFile(self.opened())
        rows = beside.open(self.files["dbf"]) if fields else io.BytesIO()
        with beside, rows, self.zip.open(self.files["shp"]) as shapes:
            shapes.seek(place)
            if fields:
                rows.seek(head + first * size)
            k = first
            while end is None or k < end:
                start = shapes.read(8)
                if len(start) < 8:
                    break
                body = shapes.read(2 * struct.unpack_from(">i", start, 4)[0])
                record = rows.read(size) if fields and k < n else b""
                box = box_of(body)
                if box is not None and not apart(box, limits):
                    found = shape(body)
                    if found:
                        yield k, {f.name: f.value(record) for f in fields} if record else {}, *found, box
                k += 1


def _opened(path: str):
    """A file that can seek, of any store that pyarrow knows."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def _batches(found: Iterator[tuple], system: str):
    """Arrow batches of some records."""
    import pyarrow as pa

    rings = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    named = [("ord", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string())), ("geom", pa.struct([("kind", pa.string()), ("parts", rings)])), ("source_crs", pa.string())]
    schema = pa.schema([*named, *((c, pa.float64()) for c in BOX)])
    held: list[dict] = []
    for k, attributes, kind, parts, box in found:
        points = [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]
        held.append({"ord": k, "attributes": list(attributes.items()), "geom": {"kind": kind, "parts": points}, "source_crs": system} | dict(zip(BOX, box)))
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    end: int | None
    place: int
    system: str


class ShapefileReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.limits: dict[str, tuple[float, float]] = {}
        if self.options.get("box"):
            x0, y0, x1, y1 = map(float, self.options["box"].split(","))
            far = float("inf")
            self.limits = {"x1": (x0, far), "y1": (y0, far), "x0": (-far, x1), "y0": (-far, y1)}

    def partitions(self):
        out = []
        for path in self.options["paths"].split("\n"):
            with Layer(partial(_opened, path), self.options["base"]) as layer:
                if "shp" in layer.files:
                    system = crs.verified(layer.text("prj"), self.options["crs"])
                    out += [Range(path, *r, system) for r in layer.ranges(int(self.options["split"]))]
        return out or [Range("", 0, 0, 0, "")]

    def read(self, partition):
        if partition.path:
            columns = self.options["columns"].split("\n") if "columns" in self.options else None
            with Layer(partial(_opened, partition.path), self.options["base"]) as layer:
                yield from _batches(layer.records(partition.first, partition.end, partition.place, columns, self.limits), partition.system)


class PushingReader(ShapefileReader):
    """The same, taking comparisons of a record's box with numbers from Spark's filters."""

    def pushFilters(self, filters):  # noqa: N802
        far = float("inf")
        for f in filters:
            side = f.attribute[0] if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if side in BOX:
                low, high = self.limits.get(side, (-far, far))
                self.limits[side] = (max(low, f.value), high) if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else (low, min(high, f.value))
            if side not in BOX or isinstance(f, (GreaterThan, LessThan)):
                yield f  # strict ones are narrowed here and judged by Spark


class ShapefileSource(DataSource):
    """Options: ``paths`` and ``columns`` (by line), ``base``, ``crs``, ``split``, ``box``, ``pushdown``."""

    @classmethod
    def name(cls):
        return "zipped_shapefile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown") == "true" else ShapefileReader)(self.options)


#: Stores whose files Python can open itself, and so at any place.
SEEKABLE = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def scan(spark: SparkSession, path: str, base: str, declared: str, columns: list[str] | None = None, box: tuple[float, float, float, float] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of a layer in its own system, with their boxes: ``ord, attributes, geom, source_crs, x0, y0, x1, y1``.

    Where the session lets Python sources take filters (``spark.sql.python.filterPushdown.enabled``), comparisons of
    the box's sides are pushed into the scan; ``box`` is used there in any case. Stores that only
    Spark can read (others than ``SEEKABLE``) are read whole, an archive to a task.
    """
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # as many as the path names
    if all(f.split(":", 1)[0] in SEEKABLE for f in files):
        spark.dataSource.register(ShapefileSource)
        options = {"paths": "\n".join(f.replace("s3a:", "s3:", 1) for f in files), "base": base, "crs": declared, "split": str(split_bytes)}
        options |= {"columns": "\n".join(columns)} if columns is not None else {}
        options |= {"box": ",".join(map(repr, map(float, box)))} if box else {}
        pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
        return spark.read.format("zipped_shapefile").options(**options, pushdown=pushes).load()
    limits = ShapefileReader({"box": ",".join(map(repr, map(float, box)))} if box else {}).limits

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                with Layer(partial(io.BytesIO, blob.as_buffer()), base) as layer:
                    if "shp" in layer.files:
                        system = crs.verified(layer.text("prj"), declared)
                        yield from _batches(layer.records(0, None, 100, columns, limits), system)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, base: str, declared: str, columns: list[str] | None = None, box: tuple[float, float, float, float] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Layer ``base`` of zipped shapefiles, in WGS 84: ``ord, attributes, geom, source_crs``.

    A layer that the archive doesn't hold gives no rows; a system other than the declared one raises. ``columns`` are the
    attributes to decode (all), ``box`` keeps the records whose box meets it, in the layer's own system.
    """
    raw = scan(spark, path, base, declared, columns, box, split_bytes).drop(*BOX)
    if declared.upper() == "EPSG:4326":
        return raw
    moved = F.transform(
        "geom.parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: G.point(*crs.to_wgs84(p["x"], p["y"], declared.upper()))))
    )
    return raw.withColumn("geom", F.struct(F.col("geom.kind").alias("kind"), moved.alias("parts")))
