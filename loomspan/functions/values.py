"""Casts, dates and guards whose results Spark and DuckDB would differ on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_int(text: Column) -> Column:
    """A whole number from text: floats round half away from zero, bad text is null."""
    return F.round(text.try_cast("double")).try_cast("bigint")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where ``bottom`` is 0 or null."""
    return F.try_divide(top.cast("double"), F.when(bottom != 0, bottom.cast("double")))


def years_between(start: Column, end: Column) -> Column:
    """Year boundaries crossed, not full years."""
    return F.year(end) - F.year(start)


def months_crossed(start: Column, end: Column) -> Column:
    """Month boundaries crossed, not full months."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def parse_date(text: Column) -> Column:
    """A date from ISO, US or day-month-name text or a spreadsheet's day
    number; null outside 1900 to 2100."""
    forms = ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "dd-MMM-yyyy")
    tries = [F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in forms]
    serial = text.try_cast("double")
    day = F.when((serial > 0) & (serial < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")))
    found = F.coalesce(*tries, day)
    return F.when(F.year(found).between(1900, 2100), found)


def year_share(start: Column, end: Column, year: Column) -> Column:
    """The share of a year's days that a closed interval covers."""
    first, last = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))
    days = F.datediff(F.least(end, last), F.greatest(start, first)) + 1
    return F.greatest(days, F.lit(0)) / (F.datediff(last, first) + 1)


def cut(value: Column, edges: list[float]) -> Column:
    """The number of the bin (left open, right closed) that holds a value;
    null outside all."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((value > a) & (value <= b), i).otherwise(out)
    return out


def list_product(values: Column) -> Column:
    """The product of a list's numbers, nulls left out; null for none."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(1.0), lambda s, x: s * x))


def list_median(values: Column) -> Column:
    """The middle of a list's numbers, or the mean of both middles."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
