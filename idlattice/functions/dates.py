"""Dates as OCR reads them: repair, normalising to YYYY-MM-DD, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .text import text_or_empty

CENTURY_PIVOT = 40


def _number(digits: Column) -> Column:
    return digits.try_cast("int")


def _year(part: Column) -> Column:
    y = F.replace(F.replace(F.upper(part), F.lit("D8"), F.lit("85")), F.lit("M2"), F.lit("23"))

    def full(digits: Column) -> Column:
        return F.when(F.length(digits) == 2, F.concat(F.when(_number(digits) > CENTURY_PIVOT, F.lit("19")).otherwise(F.lit("20")), digits)).otherwise(digits)

    return let(F.regexp_replace(F.translate(y, "DM", "82"), "[^0-9]", ""), full)


def _bounded(part: Column, most: int, fixed: dict[int, str]) -> Column:
    """A month or day: known misreadings, else in range, else its two digits swapped, else 01."""

    def inside(digits: Column) -> Column:
        n, swapped = _number(digits), F.reverse(digits)
        out = F.when((digits == "") | n.isNull(), F.lit("01"))
        for value, text in fixed.items():
            out = out.when(n == value, F.lit(text))
        padded = F.when(F.length(digits) == 1, F.lpad(digits, 2, "0")).otherwise(digits)
        return out.when(n.between(1, most), padded).when((F.length(digits) == 2) & _number(swapped).between(1, most), swapped).otherwise(F.lit("01"))

    return let(F.regexp_replace(F.translate(F.upper(part), "DM", "82"), "[^0-9]", ""), inside)


def repair_date(t: Column) -> Column:
    """Look-alike characters to digits and impossible parts to possible ones, year first.

    Texts that don't have exactly three parts stay as they are. An impossible month is
    repaired, not rejected.
    """
    cleaned = F.translate(F.regexp_replace(text_or_empty(t), r"[^a-zA-Z0-9/\-.]", " "), "OoIiLlSsBZz", "00111155822")

    def joined(parts: Column) -> Column:
        a, b, c = (F.get(parts, F.lit(k)) for k in range(3))
        day_first = (F.length(c) == 4) | ((F.length(a) != 4) & (F.length(c) == 2))
        day = _bounded(F.when(day_first, a).otherwise(c), 31, {52: "24", 0: "01"})
        year = _year(F.when(day_first, c).otherwise(a))
        return F.when(F.size(parts) == 3, let(year, lambda y: F.when(y != "", F.concat(y, F.lit("-"), _bounded(b, 12, {50: "05", 30: "01"}), F.lit("-"), day))))

    return F.coalesce(let(F.filter(F.split(cleaned, r"[/\-.\s]+"), lambda p: p != ""), joined), text_or_empty(t))


def _calendar(y: Column, m: Column, d: Column) -> Column:
    full = let(_number(y), lambda n: F.when(n < 100, F.when(n > CENTURY_PIVOT, n + 1900).otherwise(n + 2000)).otherwise(n))
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", full, _number(m), _number(d)), "yyyy-MM-dd"), "yyyy-MM-dd")


#: In this order; the groups of day, month and year. Separators are optional, so a bare year may match.
_FORMS = [
    (r"([0-9]{1,2})[/\-.\s]?([0-9]{1,2})[/\-.\s]?([0-9]{4})", (3, 2, 1)),
    (r"([0-9]{4})[/\-.\s]?([0-9]{1,2})[/\-.\s]?([0-9]{1,2})", (1, 2, 3)),
    (r"([0-9]{1,2})[/\-.\s]?([0-9]{1,2})[/\-.\s]?([0-9]{2})", (3, 2, 1)),
]


def normalize_date(t: Column) -> Column:
    """YYYY-MM-DD of a date in any of the known forms, after repair; null if none is a calendar date."""
    forms = lambda fixed: F.coalesce(*[F.when(fixed.rlike(p), _calendar(*[F.regexp_extract(fixed, p, g) for g in groups])) for p, groups in _FORMS])
    return let(F.trim(repair_date(t)), forms)


def as_date(iso: Column) -> Column:
    return F.when(iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(iso, "yyyy-MM-dd"))


def is_calendar_date(iso: Column) -> Column:
    """A real date in the years 1900 to 2100."""
    d = as_date(iso)
    return F.coalesce(F.year(d).between(1900, 2100), F.lit(False))


def mrz_date_as_read(yymmdd: Column, birth: bool) -> Column:
    """A machine-readable zone's YYMMDD with dashes and its century, unchecked: births after 26, or without a number, are of the last one."""
    yy = F.substring(yymmdd, 1, 2)
    number = yy.try_cast("int")
    century = F.when(number.isNull() | (number > 26), F.lit("19")).otherwise(F.lit("20")) if birth else F.lit("20")
    return F.concat(century, yy, F.lit("-"), F.substring(yymmdd, 3, 2), F.lit("-"), F.substring(yymmdd, 5, 2))


def mrz_date(yymmdd: Column, birth: bool) -> Column:
    """The same, null unless the zone has six digits."""
    return F.when(yymmdd.rlike("^[0-9]{6}$"), mrz_date_as_read(yymmdd, birth))


def age(birth: Column, on: Column) -> Column:
    """Full years; on 28 February a leap-day child is not yet a year older."""
    before = F.struct(F.month(on), F.dayofmonth(on)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(on) - F.year(birth) - before.cast("int")
