"""Relational operators with stated null and order semantics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; state null order in it."""
    return top_per(df, keys, order, 1).drop("_rank")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each key. Spark cuts each map partition to
    ``k`` rows a key before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """SQL's NOT IN: a null in ``other`` leaves no row, a null in ``column``
    stays only if ``other`` is empty."""
    other = other.select(F.col(other_column).alias("_other"))
    some = other.agg(F.count("*").alias("_n"), F.count("_other").alias("_known"))
    kept = df.join(other.where(F.col("_other").isNotNull()).distinct(), F.col(column) == F.col("_other"), "left_anti")
    kept = kept.crossJoin(F.broadcast(some))  # one row
    keep = (F.col("_n") == 0) | (F.col("_n") == F.col("_known")) & F.col(column).isNotNull()
    return kept.where(keep).drop("_n", "_known")


def distinct_over(column: Column, keys: list[str]) -> Column:
    """COUNT(DISTINCT column) OVER (PARTITION BY keys); nulls don't count."""
    return F.size(F.collect_set(column).over(Window.partitionBy(*keys)))


def optional(df: DataFrame, names: Iterable[str], kind: str) -> Column:
    """The first of ``names`` that ``df`` has, cast, or else a typed null."""
    for name in names:
        if name in df.columns:
            return F.col(name).cast(kind)
    return F.lit(None).cast(kind)


def align(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, typed; absent ones are
    null, others go."""
    return df.select(*[(F.col(c).try_cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in schema.items()])


def append_aligned(frames: list[DataFrame], schema: dict[str, str]) -> DataFrame:
    """UNION ALL of frames whose columns differ."""
    out = align(frames[0], schema)
    for df in frames[1:]:
        out = out.unionByName(align(df, schema))
    return out


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or a failure when it runs if a key repeats (a many-to-one check)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a key repeats"))).otherwise(True)).drop("_n")


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash of ``key``; the same each time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def cluster_sample(df: DataFrame, cluster: str, share: float, seed: int) -> DataFrame:
    """All rows of a hashed share of the clusters."""
    return df.where(F.pmod(F.xxhash64(F.col(cluster), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def hold_out(df: DataFrame, key: str, strata: list[str], share: float, seed: int) -> DataFrame:
    """Adds ``held_out``: the first ``share`` of each stratum by seeded hash."""
    window = Window.partitionBy(*strata).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    size = F.count("*").over(Window.partitionBy(*strata))
    return df.withColumn("held_out", F.row_number().over(window) <= F.floor(size * share))


def shard(column: Column, shards: int) -> Column:
    """The shard of a whole-number key."""
    return F.pmod(F.abs(column), F.lit(shards))


def join_leave(df: DataFrame, member: str, snapshot: str) -> DataFrame:
    """``member, snapshot, event``: 'join' where a member of a snapshot was
    not in the one before, 'leave' where it's gone in the next. Snapshots are
    whole numbers without gaps; the first and last make no event."""
    seen = df.select(F.col(member).alias("member"), F.col(snapshot).alias("snapshot")).distinct()
    ends = seen.agg(F.min("snapshot").alias("_first"), F.max("snapshot").alias("_last"))
    order = Window.partitionBy("member").orderBy("snapshot")
    runs = seen.withColumn("_before", F.lag("snapshot").over(order)).withColumn("_after", F.lead("snapshot").over(order))
    runs = runs.crossJoin(F.broadcast(ends))  # one row
    came = F.col("_before").isNull() | (F.col("_before") != F.col("snapshot") - 1)
    went = F.col("_after").isNull() | (F.col("_after") != F.col("snapshot") + 1)
    joins = runs.where(came & (F.col("snapshot") > F.col("_first"))).select("member", "snapshot", F.lit("join").alias("event"))
    leaves = runs.where(went & (F.col("snapshot") < F.col("_last"))).select("member", (F.col("snapshot") + 1).alias("snapshot"), F.lit("leave").alias("event"))
    return joins.unionByName(leaves)


def fill(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, forward: bool = True) -> DataFrame:
    """Adds ``out``: nulls as the last known value before (or, not
    ``forward``, the next one after) in each key's order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    value = F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)) if forward else F.first(column, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(out, value)


def dummies(df: DataFrame, column: str, values: list[str], prefix: str) -> DataFrame:
    """A 0/1 column for each of the values in place of ``column``; all 0 for
    null and for others."""
    flags = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *flags)
