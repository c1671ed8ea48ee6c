"""Column functions against hand-made cases."""

import math
import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from terrane.config import CATEGORY_KEYWORDS, TYPE_MAP
from terrane.functions import crs, dates, values
from terrane.functions import geometry as G
from terrane.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def strings(spark, f, items):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(items)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_normalise(spark):
    items = ["Al-'Isawiya", "al Isawiyya", "Beit  Ūr", "Deir’ Ballūṭ", "", None, "As-Sawiya (north)", "Khirbet ad Deir"]
    want = ["isawiya", "isawiya", "beit ur", "deir ballut", "", "", "sawiya north", "khirbet deir"]
    assert strings(spark, T.normalise, items) == want
    assert strings(spark, lambda c: T.normalise(c, exact_unicode=True), items) == want


def test_normalise_fold_first_makes_ein_and_ayn_meet(spark):
    a, b = strings(spark, lambda c: T.normalise(c, fold_first=True), ["Ayn Qiniya", "Ein Qiniya"])
    assert a == b
    assert strings(spark, T.normalise, ["Ayn Qiniya"]) == ["qiniya"]


def test_compare_keys_and_similarity(spark):
    df = spark.createDataFrame([("Bayt Mirsim", "Beit Mirsim"), ("Bani Zeid", "Bani Zeid al-Sharqiya"), ("al-Zaytouneh", "Abu Shukheidim"), ("(al-X)", "Y"), ("Khashem Adaraj (al-H)", "Khashem ad Daraj")], "a string, b string")
    same = [r[0] for r in df.select(T.same_place(T.compare_key(F.col("a")), T.compare_key(F.col("b")))).collect()]
    assert same == [True, True, False, False, True]


def test_scripts_and_search_keys(spark):
    assert strings(spark, T.normalise_arabic, ["القُدْس", "أريحا", "مدرسة", None]) == ["القدس", "اريحا", "مدرسه", ""]
    assert strings(spark, T.normalise_hebrew, ["שָׁלוֹם"]) == ["שלום"]
    df = spark.createDataFrame([("Deir Ballut",), ("Bayt Ūr",), ("שָׁלוֹם",), (None,)], "s string")
    assert [r[0] for r in df.select(T.search_keys(F.col("s"))).collect()] == [["deir ballut"], ["bayt ur", "beit ur"], ["שלום"], []]


def test_slugs_and_cleaning(spark):
    assert strings(spark, T.slug, ["  Éfrat & Co. ", "--", None]) == ["éfrat-co", "unnamed", "unnamed"]
    assert strings(spark, lambda c: T.slug(c, collapse=False), ["a  b"]) == ["a--b"]
    assert strings(spark, T.clean, [" a ", " ", None]) == ["a", None, None]
    assert strings(spark, T.clean_strict, ["___", "a�", "ok"]) == [None, None, "ok"]
    assert strings(spark, T.clean_label, ["--", "?", "é1"]) == [None, None, "é1"]


def test_categories_are_substrings_unless_words_are_asked_for(spark):
    texts = ["Army razed a home; trees uprooted", "a dwelling", None]
    assert strings(spark, lambda c: T.categorise(c, CATEGORY_KEYWORDS), texts) == [["demolition", "property_damage"], ["water_access"], []]
    assert strings(spark, lambda c: T.categorise(c, CATEGORY_KEYWORDS, whole_words=True), texts)[1] == []


def test_dates(spark):
    raw = ["07، Aug 2026", "31 Feb 2025", "5 Foo 2024", "in 1999", "x", None]
    assert strings(spark, dates.parse_listing_date, raw) == [date(2026, 8, 7), date(2025, 2, 1), date(2024, 1, 1), date(1999, 1, 1), None, None]
    assert strings(spark, dates.parse_day_first, ["01/02/2025", "31/02/2025", "NA"]) == [date(2025, 2, 1), None, None]
    assert strings(spark, lambda c: dates.plausible_date(c, date(2026, 1, 1)), ["1000-01-01", "2094-11-17", "1999-05-05T00:00", None]) == [None, None, date(1999, 5, 5), None]


def test_state_as_of(spark):
    history = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(d).cast("date").alias("valid_from"), F.lit(e).cast("date").alias("valid_to")) for s, d, e in ((1, "1990-01-01", "1995-01-01"), (4, "1992-01-01", "1993-01-01"), (3, None, None))])
    for day, reached, within in (("1989-01-01", None, None), ("1991-01-01", 1, 1), ("1994-01-01", 4, 1), ("2000-01-01", 4, None)):
        assert one(spark, dates.stage_at(history, F.lit(day).cast("date")), dates.stage_within(history, F.lit(day).cast("date"))) == (reached, within)
    assert one(spark, dates.as_of(F.lit(None).cast("date"), 2000), dates.as_of(F.lit(None).cast("date"), 2000, keep_undated=True)) == (False, True)


def test_values(spark):
    assert strings(spark, values.whole_number, ["17,230", "with Ar Ram", "NA", "", None, "12"]) == [17230, None, None, None, None, 12]
    got = strings(spark, values.number_or_note, ["17", "NA", "with Ar Ram", " ", None])
    assert [tuple(g) for g in got] == [(17, None), (None, None), (None, "with Ar Ram"), (None, None), (None, None)]
    assert strings(spark, lambda c: values.vocabulary(c, TYPE_MAP, "?"), ["Ouptost", "התנחלות", "moon base", None]) == ["outpost", "settlement", "?", "?"]
    usable = [one(spark, values.usable_coordinates(F.lit(x), F.lit(y)))[0] for x, y in ((35.0, 31.0), (float("nan"), 1.0), (-1.7976931348623157e308, 1.0), (181.0, 0.0))]
    assert usable == [True, False, False, False]
    assert one(spark, values.ramp(F.lit(5.0), [(0, 0), (10, 100)]), values.bucket(F.lit(5.0), [1, 5, 9]), values.share(F.lit(1.0), F.lit(0.0))) == (50.0, 2, None)


SQUARE = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]
DONUT = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]
FAR = [[(10, 10), (12, 10), (12, 12), (10, 12), (10, 10)]]


def parts(*polygons):
    return F.array(*[F.array(*[F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ring]) for ring in p]) for p in polygons])


@pytest.mark.parametrize("polygons,point,inside", [
    ((SQUARE,), (2, 2), True), ((SQUARE,), (5, 2), False), ((DONUT,), (2, 2), False), ((DONUT,), (0.5, 2), True), ((DONUT, FAR), (11, 11), True),
    ((SQUARE, SQUARE), (2, 2), False), ((SQUARE,), (0, 0), True), ((SQUARE,), (4, 4), False), ((), (1, 1), False),
])
def test_point_in_polygon(spark, polygons, point, inside):
    p = parts(*polygons) if polygons else F.array().cast(f"array<array<{G.RING}>>")
    assert one(spark, G.contains(p, F.lit(float(point[0])), F.lit(float(point[1])))) == (inside,)


def test_area_center_bounds(spark):
    p = parts(DONUT, FAR)
    b, c = G.bounds(p), G.ring_center(p)
    assert one(spark, G.planar_area(p), b["x1"], b["y0"], c["x"], c["y"], G.vertex_count(p), G.closed_rings(p)) == (16.0, 12.0, 0.0, 1.6, 1.6, 15, True)
    ring = F.get(F.get(parts(SQUARE), F.lit(0)), F.lit(0))
    assert one(spark, G.is_clockwise(ring), G.is_clockwise(F.reverse(ring))) == (False, True)
    assert one(spark, G.closed_rings(parts([[(0, 0), (1, 1), (0, 0)]]))) == (False,)


def test_distances_and_cells(spark):
    assert one(spark, G.segment_distance(*map(F.lit, (1.0, 1.0, 0.0, 0.0, 2.0, 0.0))), G.segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)))) == (1.0, 5.0)
    (m,) = one(spark, G.metres(F.lit(35.0), F.lit(31.0), F.lit(35.01), F.lit(31.0)))
    assert math.isclose(m, 0.01 * math.cos(math.radians(31.9)) * 111320)
    assert one(spark, G.block_cell(F.lit(-0.05)), G.block_cell(F.lit(0.05))) == (-1, 1)


def test_simplify_and_wkb(spark):
    assert G.thin_line([(0, 0), (1, 0.00001), (2, 0), (3, 1)], 1e-4) == [(0, 0), (2, 0), (3, 1)]
    tiny = parts([[(0, 0), (1e-6, 0), (1e-6, 1e-6), (0, 0)]])
    assert one(spark, G.vertex_count(G.simplify(tiny, 1e-3))) == (4,)
    blobs = [struct.pack("<BIdd", 1, 1, 35.5, 31.5), struct.pack(">BIdd", 0, 1, 35.5, 31.5), None, b"x"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(bytearray(b) if b else None,) for b in blobs], "w binary").select(G.wkb_point("w")).collect()]
    assert got[0] == got[1] == (35.5, 31.5) and got[2:] == [(None, None)] * 2


def utm_forward(lon, lat, middle=33.0):
    """Kruger's series in the third flattening, an independent way to UTM metres."""
    n = 1 / (2 * 298.257223563 - 1)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam, c = math.radians(lat), math.radians(lon - middle), 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(k * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, k in enumerate(alpha, 1))
    y = xi + sum(k * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, k in enumerate(alpha, 1))
    return 500_000 + 0.9996 * a * x, 0.9996 * a * y


def test_crs(spark):
    assert crs.identify('PROJCS["WGS_1984_UTM_Zone_36N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]]') == "EPSG:32636"
    assert crs.identify('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]') == crs.identify("epsg:4326") == "EPSG:4326"
    with pytest.raises(crs.CrsMismatch):
        crs.verified('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]', "EPSG:32636")
    with pytest.raises(ValueError):
        crs.verified(None, "EPSG:28193")
    lon, lat = one(spark, *crs.utm_inverse(F.lit(500000.0), F.lit(0.0)))
    assert abs(lon - 33) < 1e-9 and abs(lat) < 1e-9
    for lon0, lat0 in ((35.2, 31.8), (34.3, 31.4), (33.0, 10.0), (32.1, -5.0)):
        lon, lat = one(spark, *crs.to_wgs84(*map(F.lit, utm_forward(lon0, lat0)), "EPSG:32636"))
        assert abs(lon - lon0) < 2e-6 and abs(lat - lat0) < 2e-6
    degree = parts([[(35, 31), (36, 31), (36, 32), (35, 32), (35, 31)]])
    (area,) = one(spark, crs.area_m2(degree))
    assert abs(area - 1.0558e10) < 0.005e10  # one degree square at 31.5 N on the ellipsoid
