"""Predicates and repairs of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable_coordinates(lon: Column, lat: Column) -> Column:
    """Finite and on the globe; sentinels such as the smallest double are not."""
    return F.coalesce(~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90), F.lit(False))


def parsed_coordinate(raw: Column) -> Column:
    return raw.try_cast("double")


def whole_number(raw: Column) -> Column:
    """Digits with thousands commas as a number; anything else null."""
    bare = F.replace(F.trim(raw), F.lit(","), F.lit(""))
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("bigint"))


def number_or_note(raw: Column) -> Column:
    """A struct (value, note): digits are a value, blanks and NA nothing, other text a note."""
    t = F.nullif(F.trim(raw), F.lit(""))
    value = F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))
    note = F.when(value.isNull() & (F.upper(t) != "NA"), t)
    return F.struct(value.alias("value"), note.alias("note"))


def vocabulary(raw: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A closed vocabulary, case-blind, with a default for what it doesn't know."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(known, F.lower(F.trim(raw)))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def within_total(part: Column, total: Column) -> Column:
    """A group's figure, or null when it exceeds the total that should hold it."""
    return F.when(part > total, None).otherwise(part)


def drop_empty(column: Column, kind: str) -> Column:
    """Null for empty strings, lists and maps; zero and false stay."""
    if kind == "string":
        return F.nullif(column, F.lit(""))
    if kind in ("array", "map"):
        return F.when(F.size(column) > 0, column)
    return column


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage, null for an empty whole."""
    return F.round(F.try_divide(part * 100.0, whole), digits)


def ramp(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear interpolation, clamped at both ends."""
    out = F.lit(float(stops[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(value < x1, y0 + (value - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(value.isNull(), None).when(value <= stops[0][0], float(stops[0][1])).otherwise(out)


def bucket(value: Column, stops: list[float]) -> Column:
    """Number of stops at or below the value."""
    out = F.lit(0)
    for s in stops:
        out = out + F.when(value >= s, 1).otherwise(0)
    return F.when(value.isNotNull(), out)


def depopulation(status: Column, ended: Column, statuses: tuple[str, ...], years: tuple[int, int] = (1947, 1950)) -> Column:
    """Struct (depopulated, mechanism): by status, and the mechanism only when the year lies in the span."""
    gone = F.coalesce(status.isin(*statuses), F.lit(False))
    year = F.regexp_extract(F.coalesce(ended, F.lit("")), r"^(\d{4})", 1).try_cast("int")
    return F.struct(gone.alias("depopulated"), F.when(gone & year.between(*years), "depopulation_1948").alias("mechanism"))


def shown_position(historic_mode: bool, historic: Column, current: Column) -> Column:
    """The historic position where the mode asks for it and there is one."""
    return F.coalesce(historic, current) if historic_mode else current


def not_true(flag: Column) -> Column:
    """Everything but true: null counts as not true."""
    return ~F.coalesce(flag, F.lit(False))
