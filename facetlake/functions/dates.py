"""Partial dates, instants and year hierarchies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.paths import evaluate_once

_PARTIAL = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?"


def _number(c: Column, group: int, default: int) -> Column:
    digits = F.regexp_extract(c, _PARTIAL, group)
    return F.when(c.isNotNull(), F.coalesce(digits.try_cast("int"), F.lit(default)))


def partial_date(
    c: Column, default_year: int = 0, default_month: int = 0, default_day: int = 0
) -> Column:
    """Leading ``YYYY[-MM[-DD]]`` as a struct of numbers; the calendar is not checked."""
    return F.struct(
        _number(c, 1, default_year).alias("year"),
        _number(c, 2, default_month).alias("month"),
        _number(c, 3, default_day).alias("day"),
    )


def maximize_date(parts: Column, as_of: Column | None = None) -> Column:
    """Complete missing (zero) parts with the latest possible value, not after ``as_of``."""
    as_of = F.current_date() if as_of is None else as_of
    return evaluate_once(parts, lambda p: _maximized(p, as_of))


def _maximized(parts: Column, as_of: Column) -> Column:
    y, m, d = parts["year"], parts["month"], parts["day"]
    # The known parts are those of today (or there are none): today it is.
    this_month = (y == F.year(as_of)) & (
        (m == 0) | ((m == F.month(as_of)) & (d == 0))
    )
    today = (y == 0) | this_month
    zero = F.lit(0)
    month = F.when(m == 0, 12).otherwise(m)
    first = F.try_make_timestamp(y, month, F.lit(1), zero, zero, zero)
    day = F.when(d == 0, F.dayofmonth(F.last_day(first))).otherwise(d)
    return F.struct(
        F.when(today, F.year(as_of)).otherwise(y).alias("year"),
        F.when(today, F.month(as_of)).otherwise(month).alias("month"),
        F.when(today, F.dayofmonth(as_of)).otherwise(day).alias("day"),
    )


def iso_instant(c: Column) -> Column:
    """D3: strict ``yyyy-MM-ddTHH:mm:ssZ`` as an instant, whatever the session zone; else NULL."""
    strict = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), c)
    return F.try_to_timestamp(strict, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def iso_epoch(c: Column) -> Column:
    """D3: the same instant in whole seconds."""
    return F.unix_timestamp(iso_instant(c))


def year_of(c: Column) -> Column:
    """Year as text; NULL without a date, ``0`` for a date that does not parse."""
    return F.when(c != "", partial_date(c)["year"].cast("string"))


def year_path(c: Column) -> Column:
    """Century, decade and year prefixes."""
    return F.when(c != "", evaluate_once(partial_date(c)["year"], _year_prefixes))


def _year_prefixes(year: Column) -> Column:
    century = (year - F.pmod(year, F.lit(100))).cast("string")
    decade = (year - F.pmod(year, F.lit(10))).cast("string")
    return F.array(
        F.array(century), F.array(century, decade),
        F.array(century, decade, year.cast("string")),
    )


def year_path_label(path: Column, as_of_year: Column | int) -> Column:
    """The year itself, or the range covered by a decade or century up to ``as_of_year``."""
    now = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    start = F.element_at(path, -1).try_cast("int")
    end = F.least(start + F.when(F.size(path) == 1, 99).otherwise(9), now)
    span = F.when(start == end, F.concat(F.lit("In "), end)).otherwise(
        F.concat(F.lit("Between "), start, F.lit(" and "), end)
    )
    return F.when(F.size(path) >= 3, F.element_at(path, -1)).otherwise(span)


def sort_date(c: Column) -> Column:
    """Integer YYYYMMDD with zeros for missing parts; 0 without a date."""
    parts = partial_date(F.coalesce(c, F.lit("")))
    return parts["year"] * 10000 + parts["month"] * 100 + parts["day"]


def filter_date(parsed: Column, added: Column, as_of: Column | None = None) -> Column:
    """Latest day the publication date can mean, else the instant of addition."""
    zero = F.lit(0)
    published = evaluate_once(
        maximize_date(partial_date(parsed), as_of),
        lambda p: F.try_make_timestamp(p["year"], p["month"], p["day"], zero, zero, zero),
    )
    return F.coalesce(F.when(parsed != "", published), iso_instant(added))


# Accepted layouts, most detailed first. A literal Z carries no zone.
_LAYOUTS = (
    ("yyyy-MM-dd'T'HH:mm:ss", r"\d{2}:\d{2}:\d{2}"),
    ("yyyy-MM-dd'T'HH:mm", r"\d{2}:\d{2}"),
    ("yyyy-MM-dd'T'HH", r"\d{2}"),
)
_OFFSET = r"([+-])(\d{2}):?(\d{2})$"


def format_date(
    c: Column, convert_tz: bool = False, show_tz: bool = False, zone: str = "UTC"
) -> Column:
    """ISO date-times in the short English form; any other text unchanged.

    The wall clock of the text is shown, or with ``convert_tz`` the one in ``zone``. A value
    ending in a literal ``Z`` is naive; it is read as UTC when it has to be converted.
    """
    bare = F.regexp_replace(F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", ""), r"\.\d{1,6}$", "")
    wall = None
    for layout, clock in _LAYOUTS:
        text = F.when(
            c.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}T{clock}(\.\d{{1,6}})?(Z|[+-]\d{{2}}:?\d{{2}})$"),
            bare,
        )
        parsed = F.try_to_timestamp(text, F.lit(layout))
        wall = parsed if wall is None else F.coalesce(wall, parsed)

    sign = F.regexp_extract(c, _OFFSET, 1)
    minutes = (
        F.regexp_extract(c, _OFFSET, 2).try_cast("int") * 60
        + F.regexp_extract(c, _OFFSET, 3).try_cast("int")
    )
    offset = F.when(sign == "", F.lit(0)).otherwise(
        minutes * F.when(sign == "-", -1).otherwise(1)
    )
    if convert_tz:
        utc = F.timestamp_add("MINUTE", -offset, wall)
        shown = F.from_utc_timestamp(utc, zone)
    else:
        shown = wall
    out = F.date_format(shown, "M/d/yy, h:mm a")
    if show_tz:
        if convert_tz:
            name = F.lit(zone)
        else:
            name = F.when(sign == "", F.lit("None")).when(offset == 0, F.lit("UTC")).otherwise(
                F.concat(
                    F.lit("UTC"), sign, F.regexp_extract(c, _OFFSET, 2), F.lit(":"),
                    F.regexp_extract(c, _OFFSET, 3),
                )
            )
        out = F.concat(out, F.lit(" ("), name, F.lit(")"))
    return F.coalesce(out, c)
