"""Dates: lenient parsing that never raises, plausibility, and state as of a date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.config import MONTHS, SETTINGS


def parse_listing_date(raw: Column) -> Column:
    """``07، Aug 2026`` and the like. An unknown month gives 1 January, a bad day the first of the month."""
    t = F.trim(F.regexp_replace(F.translate(raw, "،,", "  "), r"\s+", " "))
    form = r"^(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})"
    year, day = F.regexp_extract(t, form, 3), F.regexp_extract(t, form, 1)
    known = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, f"{k:02d}")])
    month = F.try_element_at(known, F.lower(F.substring(F.regexp_extract(t, form, 2), 1, 3)))
    full = F.coalesce(F.try_to_date(F.concat_ws("-", year, month, F.lpad(day, 2, "0"))), F.try_to_date(F.concat_ws("-", year, month, F.lit("01"))))
    only = F.regexp_extract(t, r"(\d{4})", 1)
    first = F.try_to_date(F.concat(F.when(year != "", year).otherwise(only), F.lit("-01-01")))
    return F.when((year != "") & month.isNotNull(), full).when((year != "") | (only != ""), first)


def parse_day_first(raw: Column) -> Column:
    """DD/MM/YYYY; null when it is no date."""
    return F.try_to_date(raw, "d/M/yyyy")


def plausible_date(raw: Column, until: date, since: date = SETTINGS.plausible_from) -> Column:
    """The ISO date at the start of the text when it lies in the range, else null."""
    day = F.try_to_date(F.substring(raw, 1, 10))
    return F.when(day.between(F.lit(since), F.lit(until)), day)


def rejected(raw: Column, parsed: Column) -> Column:
    """A value was there and didn't stand."""
    return F.nullif(F.trim(raw), F.lit("")).isNotNull() & parsed.isNull()


def feature_date(*named: Column, history: Column | None = None) -> Column:
    """The first of the named dates that is there, else the earliest start in the stage history."""
    found = list(named)
    if history is not None:
        found.append(F.array_min(F.transform(history, lambda e: e["valid_from"])))
    return F.coalesce(*found)


def as_of(day: Column, year: int, keep_undated: bool = False) -> Column:
    """Whether something dated ``day`` exists by the end of a year; the undated by choice."""
    return F.coalesce(F.year(day) <= year, F.lit(keep_undated))


def stage_at(history: Column, day: Column) -> Column:
    """The highest stage begun by a day; null if none. Ends are not looked at."""
    begun = F.filter(history, lambda e: e["valid_from"] <= day)
    return F.array_max(F.transform(begun, lambda e: e["stage"]))


def stage_within(history: Column, day: Column) -> Column:
    """The highest stage whose interval holds the day."""
    open_ = F.filter(history, lambda e: (e["valid_from"] <= day) & F.coalesce(e["valid_to"] >= day, F.lit(True)))
    return F.array_max(F.transform(open_, lambda e: e["stage"]))


def visible_extent(history: Column, declared: Column, year: int) -> Column:
    """Shown by a year: a stage was reached, or nothing says that it was declared later."""
    reached = stage_at(history, F.make_date(F.lit(year), F.lit(12), F.lit(31)))
    return reached.isNotNull() | declared.isNull() | (F.year(declared) <= year)


def minimum_stage(stage: int, observed: Column, evidence: Column) -> Column:
    """One event at the date of observation: the least that a source proves."""
    return F.array(F.struct(F.lit(stage).alias("stage"), observed.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), evidence.alias("evidence")))
