"""Coordinate reference systems: identification, and the three that are needed in closed form.

WGS 84 passes through; UTM zones on WGS 84 are inverted by the series of Snyder (USGS PP 1395);
cylindrical equal area gives areas. Systems that need a datum shift are refused by name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.config import SETTINGS

A, INVERSE_F = 6378137.0, 298.257223563
E2 = 2 / INVERSE_F - 1 / INVERSE_F**2
K0, FALSE_EASTING = 0.9996, 500_000.0
NEEDS_DATUM_SHIFT = {"EPSG:28193": "Israeli TM on Cassini's datum", "EPSG:2039": "Israel 1993"}


class CrsMismatch(ValueError):
    """The declared system isn't the one that the file names."""


def identify(prj: str) -> str:
    """The EPSG code that a ``.prj`` text or a user's input names."""
    text = prj.strip()
    if re.fullmatch(r"(?i)epsg:\d+", text):
        return text.upper()
    codes = re.findall(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]|ID\["EPSG",\s*(\d+)\]', text)
    if codes:
        return "EPSG:" + next(c for c in codes[-1] if c)
    zone = re.search(r"UTM[_ ]zone[_ ](\d{1,2})([NS])", text, re.IGNORECASE)
    if zone and re.search(r"WGS[_ ]?(?:19)?84", text, re.IGNORECASE):
        return f"EPSG:{(326 if zone[2].upper() == 'N' else 327)}{int(zone[1]):02d}"
    if text.startswith("PROJCS") and "Israel" in text:
        return "EPSG:2039"
    if text.startswith("GEOGCS") and re.search(r"WGS[_ ]?(?:19)?84", text, re.IGNORECASE):
        return "EPSG:4326"
    raise ValueError(f"unknown coordinate reference system: {text[:80]}")


def verified(prj: str | None, declared: str) -> str:
    """The declared system, after the file's own has been held against it."""
    if prj and (found := identify(prj)) != declared.upper():
        raise CrsMismatch(f"declared {declared}, the file says {found}")
    if declared.upper() in NEEDS_DATUM_SHIFT:
        raise ValueError(f"{declared} ({NEEDS_DATUM_SHIFT[declared.upper()]}) needs a datum shift, which isn't done here")
    return declared.upper()


def utm_inverse(x: Column, y: Column, zone: int = 36, north: bool = True) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of UTM metres."""
    ep2 = E2 / (1 - E2)
    m = (y - (0.0 if north else 10_000_000.0)) / K0
    mu = m / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    phi = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    c1, t1 = ep2 * cos * cos, tan * tan
    n1 = A / F.sqrt(1 - E2 * sin * sin)
    r1 = A * (1 - E2) / F.pow(1 - E2 * sin * sin, 1.5)
    d = (x - FALSE_EASTING) / (n1 * K0)
    lat = phi - (n1 * tan / r1) * (
        d * d / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * F.pow(d, 4) / 24
        + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * F.pow(d, 6) / 720
    )
    lon = (d - (1 + 2 * t1 + c1) * F.pow(d, 3) / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * F.pow(d, 5) / 120) / cos
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def to_wgs84(x: Column, y: Column, source: str) -> tuple[Column, Column]:
    """Longitude and latitude, rounded to six digits unless they already were."""
    if source == "EPSG:4326":
        return x, y
    code = re.fullmatch(r"EPSG:32([67])(\d\d)", source)
    if not code:
        raise ValueError(f"no closed form for {source}")
    lon, lat = utm_inverse(x, y, int(code[2]), code[1] == "6")
    return F.round(lon, SETTINGS.coordinate_digits), F.round(lat, SETTINGS.coordinate_digits)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area metres, true at the reference latitude."""
    e = math.sqrt(E2)
    ts = math.radians(SETTINGS.reference_latitude)
    k0 = math.cos(ts) / math.sqrt(1 - E2 * math.sin(ts) ** 2)
    sin = F.sin(F.radians(lat))
    q = (1 - E2) * (sin / (1 - E2 * sin * sin) - (1 / (2 * e)) * F.log((1 - e * sin) / (1 + e * sin)))
    return A * k0 * F.radians(lon - SETTINGS.reference_longitude), A * q / (2 * k0)


def area_m2(parts: Column, digits: int = 1) -> Column:
    """Ellipsoidal area of polygon parts in square metres."""
    from terrane.functions.geometry import planar_area, point

    flat = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: point(*equal_area(v["x"], v["y"])))))
    return F.round(F.abs(planar_area(flat)), digits)
