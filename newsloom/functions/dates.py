"""Date expressions: tolerant parsing and the three kinds of week."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values

EXCEL_ZERO = "1899-12-30"


def monday(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def weeks_since(d: Column, first: Column) -> Column:
    """Whole weeks since ``first``."""
    return F.floor(F.date_diff(d, first) / 7)


def excel_or_iso(c: Column) -> Column:
    """A spreadsheet's day number, a full date, or a month (its 15th day); anything else is null."""
    return (
        F.when(c.rlike(r"^\d+(\.\d+)?$"), F.date_add(F.lit(EXCEL_ZERO).cast("date"), F.floor(c.try_cast("double")).cast("int")))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
        .when(c.rlike(r"^\d{4}-\d{2}$"), F.date_add(F.try_to_date(c, "yyyy-MM"), 14))
    )


def patched(c: Column) -> Column:
    """Known corruptions put right, then the first format that fits."""
    fixed = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.DATE_FIXES.items() for x in pair)), c), c)
    iso = F.when(fixed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(fixed, "yyyy-MM-dd"))
    return F.coalesce(iso, F.try_to_date(fixed, "MMM d, yyyy"), F.try_to_date(fixed, "MMMM d, yyyy"), F.try_to_date(fixed, "d MMM yyyy"), F.try_to_date(fixed, "yyyy/MM/dd"))


def month_day_year(c: Column) -> Column:
    return F.coalesce(F.try_to_date(c, "MMM d, yyyy"), F.try_to_date(c, "MMMM d, yyyy"))


def in_range(d: Column, first: str = values.DATE_RANGE[0], last: str = values.DATE_RANGE[1]) -> Column:
    return d.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
