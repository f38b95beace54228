"""Currency of evidence; the reference date is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency(year: Column, this_year: int) -> Column:
    age = F.lit(this_year) - year
    return F.when(year.isNull(), "UNKNOWN").when(age <= 3, "CURRENT").when(age <= 8, "RECENT").otherwise("HISTORICAL")


def is_current(year: Column, this_year: int, years: int = 5) -> Column:
    """An unknown year counts as current."""
    return year.isNull() | (year >= this_year - years)


def grant_active(end: Column, as_of: str) -> Column:
    return F.coalesce(F.try_to_date(end) >= F.lit(as_of).cast("date"), F.lit(False))
