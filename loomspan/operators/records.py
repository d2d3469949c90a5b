"""Record clean-up and panels of people: duplicates, cascades, status flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(sources: list[tuple[DataFrame, int]], key: str, value: str) -> DataFrame:
    """``key, value, priority``: from sources of falling priority the value of
    the highest that names just one; a source that names several is passed over."""
    rows = None
    for df, priority in sources:
        part = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_other"))
        part = part.where(F.col(value) == F.col("_other")).select(key, value, F.lit(priority).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.max_by(value, "priority").alias(value), F.max("priority").alias("priority"))


def overlapping_neighbours(df: DataFrame, keys: list[str], start: str, end: str, slack: int, ties: list[str] | None = None) -> DataFrame:
    """Adds ``overlaps``: whether a spell starts before the furthest end so
    far of its key's earlier spells, plus ``slack``; a sweep, not a self-join.
    Spells of one start and end follow each other by ``ties``."""
    order = Window.partitionBy(*keys).orderBy(start, end, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("overlaps", F.coalesce(F.col(start) <= F.max(end).over(order) + slack, F.lit(False)))


def status_flags(start: Column, end: Column, at: Column) -> dict[str, Column]:
    """Before, during or after a spell: exactly one holds where both ends are known."""
    return {"before": at < start, "during": (at >= start) & (at <= end), "after": at > end}


def birth_year(school_end: Column, college_start: Column, degree_end: Column) -> Column:
    """A guess at the year of birth: 18 at the end of school, else the
    earliest of 18 at a college's start and 23 at a degree's end."""
    return F.coalesce(school_end - 18, F.least(college_start - 18, degree_end - 23))


def new_pairs(df: DataFrame, a: str, b: str, time: str, since: int) -> DataFrame:
    """Adds ``keep``: false for a pair first seen after ``since`` whose two
    sides had both been seen before, but never together."""
    first = lambda cols: F.min(time).over(Window.partitionBy(*cols))
    fresh = F.col(time) == F.col("_both")
    known = (F.col("_a") < F.col(time)) & (F.col("_b") < F.col(time))
    df = df.withColumn("_a", first([a])).withColumn("_b", first([b])).withColumn("_both", first([a, b]))
    return df.withColumn("keep", ~((F.col(time) > since) & fresh & known)).drop("_a", "_b", "_both")


def trajectory(df: DataFrame, key: str, value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """``key, total, peak, active_share, kind``: exposure summed, and its kind
    by quantiles of the positive totals (none, low, middle, high)."""
    per = df.groupBy(key).agg(F.sum(value).alias("total"), F.max(value).alias("peak"), F.avg((F.col(value) > 0).cast("double")).alias("active_share"))
    cut = F.when(F.col("total") > 0, F.col("total"))
    cuts = per.agg(F.percentile(cut, low).alias("_l"), F.percentile(cut, high).alias("_h"))
    kind = F.when(F.col("total") <= 0, "none").when(F.col("total") <= F.col("_l"), "low").when(F.col("total") >= F.col("_h"), "high").otherwise("middle")
    return per.crossJoin(F.broadcast(cuts)).withColumn("kind", kind).drop("_l", "_h")  # one row


def window_shares(df: DataFrame, unit: str, option: str, time: str, size: str, windows: dict[str, tuple[int, int]], least_options: int) -> DataFrame:
    """Shares of options in their unit, for several windows in one pass; units
    with fewer options go."""
    sums = [F.sum(F.when(F.col(time).between(a, b), F.col(size)).otherwise(0)).alias(name) for name, (a, b) in windows.items()]
    per = df.groupBy(unit, option).agg(*sums)
    whole = Window.partitionBy(unit)
    per = per.withColumn("_k", F.count("*").over(whole)).where(F.col("_k") >= least_options)
    return per.select(unit, option, *[F.try_divide(F.col(n), F.sum(n).over(whole)).alias(n) for n in windows])
