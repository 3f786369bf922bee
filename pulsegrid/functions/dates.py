"""Dates found in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .common import ColumnOrName, col, lookup, moment

MONTH = "(" + "|".join(fixed.MONTHS) + ")"


def latest_post_date(text: ColumnOrName, as_of) -> Column:
    """The latest plausible date in ``text``: ISO, "Month D, YYYY", "D Month YYYY" or
    "N days/weeks/months ago" (a month is 30 days). Impossible dates, dates before 2000
    and dates more than a day after ``as_of`` are dropped."""
    text, now = F.coalesce(col(text), F.lit("")), moment(as_of)

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), 0)

    def written(m: Column) -> Column:
        month = lookup(fixed.MONTHS, F.lower(F.regexp_extract(m, r"([A-Za-z]+)", 1)))
        year = F.regexp_extract(m, r"(\d{4})$", 1)
        day = F.regexp_extract(m, r"(?:^|[A-Za-z]\s+)(\d{1,2})(?!\d)", 1)
        return F.concat_ws("-", year, month.cast("string"), day).try_cast("date").cast("timestamp_ntz")

    def ago(m: Column) -> Column:
        amount = F.regexp_extract(m, r"^(\d+)", 1).try_cast("int")
        unit = F.lower(F.regexp_extract(m, r"^\d+\s+([A-Za-z])", 1))
        days = amount * F.when(unit == "d", 1).when(unit == "w", 7).otherwise(30)
        return F.when(amount <= 1_000_000, now - F.make_dt_interval(days))

    dates = F.concat(
        F.transform(found(r"\b\d{4}-\d{2}-\d{2}\b"), lambda m: m.try_cast("date").cast("timestamp_ntz")),
        F.transform(found(rf"(?i)\b{MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b"), written),
        F.transform(found(rf"(?i)\b\d{{1,2}}\s+{MONTH}\s+\d{{4}}\b"), written),
        F.transform(found(r"(?i)\b\d+\s+(?:days?|weeks?|months?)\s+ago\b"), ago),
    )
    latest = now + F.expr("interval 1 day")
    return F.array_max(F.filter(dates, lambda d: (F.year(d) >= 2000) & (d <= latest)))


def days_since(date: ColumnOrName, as_of) -> Column:
    """Whole days from ``date`` to ``as_of`` (24-hour days, rounded down)."""
    end, start = moment(as_of), col(date).cast("timestamp_ntz")
    # Dates and clock times of zone-less values: no session zone or clock change comes in.
    clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.date_diff(F.to_date(end), F.to_date(start)) - F.when(clock(end) < clock(start), 1).otherwise(0)


def is_inactive(date: ColumnOrName, as_of, threshold_days: int = 365) -> Column:
    return F.coalesce(days_since(date, as_of) > threshold_days, F.lit(True))
