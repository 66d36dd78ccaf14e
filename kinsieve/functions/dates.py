"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinsieve.functions.numbers import round_even

# Spreadsheet day zero, mean year length, imputed month and day.
SERIAL_ORIGIN = "1899-12-30"
DAYS_PER_YEAR = 365.25
MID_YEAR_MONTH = 6
MID_MONTH_DAY = 15


def from_serial(serial: Column) -> Column:
    """Date of a spreadsheet serial number (fractions of a day are cut off)."""
    return F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(serial).cast("int"))


def partial_date(year: Column, month: Column) -> Column:
    """Mid-month date from year and month; a missing month counts as June, a missing or impossible part
    gives NULL."""
    text = F.format_string(
        "%04d-%02d-%02d", year.cast("int"), F.coalesce(month.cast("int"), F.lit(MID_YEAR_MONTH)), F.lit(MID_MONTH_DAY)
    )
    return F.when(year.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def parse_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Date from text; NULL where it does not parse."""
    return F.try_to_date(text, pattern)


def date_part(ts: Column) -> Column:
    return F.to_date(ts)


def time_part(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def years_between(later: Column, earlier: Column, digits: int = 2) -> Column:
    return round_even(F.datediff(later, earlier) / F.lit(DAYS_PER_YEAR), digits)


def shift_years(day: Column, years: Column) -> Column:
    """Date moved by a fractional number of years, cut to whole days."""
    return F.date_add(day, F.floor(years * DAYS_PER_YEAR).cast("int"))
