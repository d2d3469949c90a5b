"""Panels: spells to years, dense grids, frames, events, shift shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.values import ratio


def spell_years(df: DataFrame, start: Column, end: Column, first: int, last: int, year: str = "year") -> DataFrame:
    """A row for each year that a spell touches, clamped to [first, last]; an
    open end runs to ``last``; a spell that ends before it starts has none."""
    a = F.greatest(F.year(start), F.lit(first))
    b = F.least(F.coalesce(F.year(end), F.lit(last)), F.lit(last))
    return df.where(a <= b).withColumn(year, F.explode(F.sequence(a, b)))


def densify(df: DataFrame, keys: list[str], time: str, fill: list[str]) -> DataFrame:
    """Every whole number of ``time`` from a key's first to its last; absent
    rows have 0 in ``fill``. ``keys`` and ``time`` are unique."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(time))
    return grid.join(df, [*keys, time], "left").fillna(0, fill)


def grid(df: DataFrame, keys: list[str], time: str, first: int, last: int, fill: list[str]) -> DataFrame:
    """Every key in every year of [first, last]."""
    whole = df.select(*keys).distinct().withColumn(time, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return whole.join(df, [*keys, time], "left").fillna(0, fill)


def overlap_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], buffer: int, now: int) -> DataFrame:
    """Rows of one key whose year spans overlap within ``buffer`` years; an
    unknown start passes, an unknown end is ``now``."""
    start_a, end_a = F.coalesce(F.col(a[0]), F.lit(-9999)), F.coalesce(F.col(a[1]), F.lit(now))
    start_b, end_b = F.coalesce(F.col(b[0]), F.lit(-9999)), F.coalesce(F.col(b[1]), F.lit(now))
    other = right.withColumnRenamed(key, "_key")
    return left.join(other, (F.col(key) == F.col("_key")) & (start_a <= end_b + buffer) & (end_a >= start_b - buffer)).drop("_key")


def islands(df: DataFrame, keys: list[str], time: str, order: list[str], breaks: Column, out: str = "island") -> DataFrame:
    """Numbers runs from 0: ``breaks`` of the gap column ``_before`` (the time
    of the row before) starts a new one."""
    window = Window.partitionBy(*keys).orderBy(time, *order)
    df = df.withColumn("_before", F.lag(time).over(window))
    new = F.when(F.col("_before").isNotNull() & breaks, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", "_new")


def frame_mean(keys: list[str], time: str, value: str, low: int, high: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(time).rowsBetween(low, high))


def growth(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Adds ``g_level`` (change), ``g_asinh`` (change of asinh), ``g_demeaned``
    (change less the time's mean) and ``g_base`` (change over the first value)."""
    order = Window.partitionBy(key).orderBy(time)
    df = df.withColumn("g_level", F.col(value) - F.lag(value).over(order))
    df = df.withColumn("g_asinh", F.asinh(F.col(value)) - F.asinh(F.lag(value).over(order)))
    df = df.withColumn("g_demeaned", F.col("g_level") - F.avg("g_level").over(Window.partitionBy(time)))
    first = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("g_base", ratio(F.col("g_level"), first))


def shares(df: DataFrame, unit: str, shock: str, size: str) -> DataFrame:
    """``unit, shock, share`` of the unit's total; null above 1."""
    total = df.groupBy(unit, shock).agg(F.sum(size).alias("_x"))
    share = ratio(F.col("_x"), F.sum("_x").over(Window.partitionBy(unit)))
    return total.select(unit, shock, F.when(share <= 1, share).alias("share"))


def shift_share(share: DataFrame, shift: DataFrame, unit: str, shock: str, time: str, growths: list[str]) -> DataFrame:
    """``unit, time, z_<growth>, active``: share-weighted sums of the shocks,
    and how many shocks are not 0."""
    both = share.join(shift, shock)
    sums = [F.sum(F.col("share") * F.col(g)).alias(f"z_{g}") for g in growths]
    active = F.count_if((F.col("share") > 0) & (F.coalesce(F.col(growths[0]), F.lit(0.0)) != 0)).alias("active")
    return both.groupBy(unit, time).agg(*sums, active)


def leave_one_out(share: DataFrame, shift: DataFrame, unit: str, shock: str, time: str, growth_col: str) -> DataFrame:
    """``shock, unit, time, z``: the instrument without each shock in turn, as
    the total less its component."""
    part = share.join(shift, shock).select(unit, time, shock, (F.col("share") * F.col(growth_col)).alias("_p"))
    total = F.sum("_p").over(Window.partitionBy(unit, time))
    return part.select(shock, unit, time, (total - F.coalesce("_p", F.lit(0.0))).alias("z"))


def largest_jump(df: DataFrame, key: str, time: str, value: str, least: float, quantile: float) -> DataFrame:
    """``key, event_time, jump``: the first of the largest rises of each key
    that reach ``least`` and the overall ``quantile`` of positive rises."""
    order = Window.partitionBy(key).orderBy(time)
    diff = df.withColumn("_d", F.col(value) - F.lag(value).over(order)).where("_d > 0")
    cut = diff.agg(F.greatest(F.percentile("_d", quantile), F.lit(least)).alias("_cut"))
    high = diff.crossJoin(F.broadcast(cut)).where(F.col("_d") >= F.col("_cut"))  # one row
    return high.groupBy(key).agg(F.max_by(time, F.struct("_d", -F.col(time))).alias("event_time"), F.max("_d").alias("jump"))


def mean_break(df: DataFrame, key: str, time: str, value: str, pre: int, post: int) -> DataFrame:
    """``key, event_time, score``: the time at which the mean of the ``post``
    rows from it exceeds that of the ``pre`` rows before it most; only times
    with all of them count, and the first of equals."""
    order = Window.partitionBy(key).orderBy(time)
    before, after = order.rowsBetween(-pre, -1), order.rowsBetween(0, post - 1)
    full = (F.count(value).over(before) == pre) & (F.count(value).over(after) == post)
    df = df.withColumn("_s", F.avg(value).over(after) - F.avg(value).over(before)).withColumn("_full", full).where("_full")
    return df.groupBy(key).agg(F.max_by(time, F.struct(F.round("_s", 9), -F.col(time))).alias("event_time"), F.max("_s").alias("score"))


def absorbing(df: DataFrame, key: str, time: str, event: Column) -> DataFrame:
    """Adds ``treated``: 1 from a key's first event on."""
    order = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("treated", F.max(event.cast("int")).over(order))


def relabels(df: DataFrame, unit: str, option: str, time: str, value: str, drop: float, gain: float) -> DataFrame:
    """``unit, time, source, target, offset_share``: an option falls by
    ``drop`` of its level while another of the unit rises by ``gain`` of its
    own; for each source the target of the best offset, then the best of a
    unit and time."""
    order = Window.partitionBy(unit, option).orderBy(time)
    diff = df.withColumn("_was", F.lag(value).over(order)).withColumn("_d", F.col(value) - F.lag(value).over(order))
    falls = diff.where(F.col("_d") < -drop * F.col("_was")).select(unit, time, F.col(option).alias("source"), (-F.col("_d")).alias("_fall"))
    rises = diff.where(F.col("_d") > gain * F.col("_was")).select(unit, time, F.col(option).alias("target"), F.col("_d").alias("_rise"))
    both = falls.join(rises, [unit, time]).withColumn("offset_share", F.least(F.col("_rise") / F.col("_fall"), F.col("_fall") / F.col("_rise")))
    for keys, tie in ((["source"], "target"), ([], "source")):
        best = Window.partitionBy(unit, time, *keys).orderBy(F.round("offset_share", 9).desc(), tie)
        both = both.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return both.select(unit, time, "source", "target", "offset_share")


def event_panel(df: DataFrame, events: DataFrame, key: str, time: str, low: int, high: int) -> DataFrame:
    """Rows within [low, high] of their key's ``event_time``, with ``rel``."""
    both = df.join(events.select(key, "event_time"), key).withColumn("rel", F.col(time) - F.col("event_time"))
    return both.where(F.col("rel").between(low, high))


def stack(df: DataFrame, events: DataFrame, key: str, time: str, low: int, high: int) -> DataFrame:
    """One stack for each event time: the keys treated then, and as controls
    those without an event up to the end of its window."""
    cohorts = events.select(F.col("event_time").alias("stack")).distinct()
    marked = df.join(events.select(key, "event_time"), key, "left")
    near = marked.withColumn("stack", F.explode(F.sequence(F.col(time) - high, F.col(time) - low))).join(cohorts, "stack")
    near = near.withColumn("rel", F.col(time) - F.col("stack"))
    treated = F.col("event_time") == F.col("stack")
    clean = F.col("event_time").isNull() | (F.col("event_time") > F.col("stack") + high)
    return near.where(F.coalesce(treated, F.lit(False)) | clean).withColumn("treated", F.coalesce(treated, F.lit(False)).cast("int")).drop("event_time")


def lags_wide(df: DataFrame, key: str, time: str, value: str, lags: list[int]) -> DataFrame:
    """``key, time`` and the value at each lag as a column of its own."""
    name = lambda k: f"{value}_{'m' if k < 0 else 'p'}{abs(k)}"
    spread = df.select(key, F.col(time).alias("_t"), value, F.explode(F.array(*[F.lit(k) for k in lags])).alias("_k"))
    spread = spread.select(key, (F.col("_t") - F.col("_k")).alias(time), "_k", value)
    return spread.groupBy(key, time).agg(*[F.max(F.when(F.col("_k") == k, F.col(value))).alias(name(k)) for k in lags])


def balanced(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """Keys that are seen at ``n`` different times."""
    whole = df.groupBy(key).agg(F.count_distinct(time).alias("_n")).where(F.col("_n") == n).select(key)
    return df.join(whole, key, "left_semi")


def quantile_bins(df: DataFrame, value: str, bins: int, out: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``out``: 1 to ``bins`` by interpolated quantile breaks, right ends
    included; breaks that coincide leave bins empty."""
    cuts = [F.percentile(value, i / bins).alias(f"_q{i}") for i in range(1, bins)]
    at = F.lit(1)
    for i in range(1, bins):
        at = at + (F.col(value) > F.col(f"_q{i}")).cast("int")
    if keys:
        df = df.join(df.groupBy(*keys).agg(*cuts), keys)
    else:
        df = df.crossJoin(F.broadcast(df.agg(*cuts)))  # one row
    return df.withColumn(out, F.when(F.col(value).isNotNull(), at)).drop(*[f"_q{i}" for i in range(1, bins)])


def pre_period(df: DataFrame, key: str, time: str, value: str, first: int, last: int) -> DataFrame:
    """``key, level, slope, coverage`` of [first, last]."""
    own = df.where(F.col(time).between(first, last))
    slope = F.when(F.count(value) >= 3, F.regr_slope(value, time))
    return own.groupBy(key).agg(F.avg(value).alias("level"), slope.alias("slope"), (F.count(value) / (last - first + 1)).alias("coverage"))
