"""Half-year arithmetic and date parsing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS_PER_SEMESTER = 6


def half_year_floor(day: Column) -> Column:
    """First day of the half-year: 1 January or 1 July."""
    first_month = F.when(F.month(day) <= 6, F.lit(1)).otherwise(F.lit(7))
    return F.make_date(F.year(day), first_month, F.lit(1))


def add_semesters(day: Column, semesters: Column) -> Column:
    return F.add_months(day, (semesters * MONTHS_PER_SEMESTER).cast("int"))


def half_years_elapsed(day: Column, as_of: Column) -> Column:
    """Half-years from `day` to `as_of`, both included, by 365-day years.

    January to July of one year counts as none elapsed, because 181 days are
    less than half of 365; `half_years_elapsed_calendar` counts by calendar.
    """
    days = F.datediff(half_year_floor(as_of), half_year_floor(day))
    return F.floor(days.cast("double") / F.lit(365.0) * F.lit(2.0)).cast("bigint") + 1


def half_years_elapsed_calendar(day: Column, as_of: Column) -> Column:
    def number(d: Column) -> Column:
        return F.year(d) * 2 + F.when(F.month(d) > 6, 1).otherwise(0)

    return (number(as_of) - number(day) + 1).cast("bigint")


def semester_starts(first: date, last: date) -> list[date]:
    """Every half-year start from `first` to `last`, both included."""
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month, 6)
    return [date(m // 12, m % 12 + 1, first.day) for m in months]


def parse_day_first(text: Column) -> Column:
    """`dd/MM/yyyy` text to date; null where the text is not such a date."""
    return F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date")


def age_years(born: Column, on: Column) -> Column:
    """Whole years between two dates, counted as days / 365.25."""
    return F.floor(F.datediff(on, born) / F.lit(365.25)).cast("bigint")


def long_date(day: Column) -> Column:
    """Day, month name and year, such as `01 December 2018`."""
    return F.date_format(day, "dd MMMM yyyy")


def year_range(day: Column, first_year: int) -> Column:
    """`year(day) >= first_year` as a comparison the scan can use."""
    return day >= F.lit(date(first_year, 1, 1))
