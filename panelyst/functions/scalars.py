"""Scalar functions: dates, ages, padding, indicators and display text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyst.functions.nulls import as_col, if_else

# Day-number origin, days per year, visit window in days.
DAY_ORIGIN = "1960-01-01"
DAYS_PER_YEAR = 365.25
WINDOW_DAYS = 183


def from_day_number(c: Column | str) -> Column:
    """Statistical-package day number (days since 1960-01-01) to a date."""
    return F.date_add(F.lit(DAY_ORIGIN).cast("date"), as_col(c).cast("int"))


def parse_date(c: Column | str) -> Column:
    """ISO text to date; text that is no date becomes NULL."""
    return F.try_to_timestamp(as_col(c), F.lit("yyyy-MM-dd")).cast("date")


def age_years(as_of: Column | str, born: Column | str) -> Column:
    """Whole years between two dates, a year being 365.25 days."""
    return F.floor(F.datediff(as_col(as_of), as_col(born)) / F.lit(DAYS_PER_YEAR)).cast("int")


def days_before(index: Column | str, event: Column | str) -> Column:
    return F.datediff(as_col(index), as_col(event))


def within_days(index: Column | str, event: Column | str, days: int = WINDOW_DAYS) -> Column:
    """Event on the index date or at most ``days`` before it."""
    return days_before(index, event).between(0, days)


def log_plus_one(c: Column | str) -> Column:
    return F.log1p(as_col(c).cast("double"))


def pad_left(c: Column | str, width: int, fill: str = "0") -> Column:
    """Pad to ``width``; longer text is left whole (``lpad`` alone would cut it)."""
    text = as_col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def positive(c: Column | str) -> Column:
    """1 for the answer 1, 0 for any other answer, NULL for none."""
    return (as_col(c) == 1).cast("int")


def positive_in_range(c: Column | str, low: int = 0, high: int = 10) -> Column:
    """1 strictly between the bounds, 0 outside, NULL for no answer."""
    c = as_col(c)
    return if_else((c > low) & (c < high), F.lit(1), F.lit(0))


def round_to(c: Column | str, digits: int = 0) -> Column:
    """Round half away from zero."""
    return F.round(as_col(c), digits)


def ratio(part: Column | str, whole: Column | str, digits: int | None = None) -> Column:
    """Share that is NULL, not an error, for an empty denominator."""
    r = F.try_divide(as_col(part).cast("double"), as_col(whole).cast("double"))
    return r if digits is None else F.round(r, digits)


def percent_text(share: Column | str, digits: int = 1) -> Column:
    """``0.1234`` as ``12.3%``."""
    return F.when(
        as_col(share).isNotNull(),
        F.concat(F.format_string(f"%.{digits}f", as_col(share) * 100), F.lit("%")),
    )


def count_text(n: Column | str, share: Column | str, total: Column | str | None = None) -> Column:
    """``n (p%)``, or ``n/total (p%)`` when a total is given."""
    left = as_col(n).cast("string")
    if total is not None:
        left = F.concat_ws("/", left, as_col(total).cast("string"))
    return F.concat(left, F.lit(" ("), percent_text(share), F.lit(")"))


def entity_key(*cols: Column | str, sep: str = "_") -> Column:
    """Composite key as one display string."""
    return F.concat_ws(sep, *[as_col(c).cast("string") for c in cols])


def key_part(c: Column | str, index: int, sep: str = "_") -> Column:
    """The ``index``-th (1-based) part of a separated text."""
    return F.split_part(as_col(c), F.lit(sep), F.lit(index))


def replace_text(c: Column | str, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(as_col(c), pattern, replacement)


def extract_text(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL when the pattern does not occur."""
    c = as_col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def years_since(as_of: Column | str, year: Column | str) -> Column:
    return F.year(as_col(as_of)) - as_col(year)


def coalesce_codes(c: Column | str, codes: Sequence) -> Column:
    """The column with the listed codes blanked out."""
    c = as_col(c)
    return F.when(~c.isin(list(codes)), c)
