"""Numbers and sums over a whole order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.storage import settle


def running_total(df: DataFrame, order: list[str], value: Column, out: str, group: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one, in
    ``order``, over all rows or within each ``group``.

    Rows are dealt by ranges of (group, order); each range is summed on its
    own and a table of one row per range and group carries the sums over. No
    task sees more than a range, however large one group is. Nulls sort
    first; ``value`` must not be null. Rows that tie in ``order`` follow each
    other in any order.
    """
    group = group or []
    ranged = df.withColumn("_value", value).repartitionByRange(*group, *order)
    ranged = settle(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range", *group).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    sums = sums.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group], "_before")
    on = [F.col("_range") == F.col("_r"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]]
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(sums, on).withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).select(*df.columns, out)


def row_ids(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 1, 2, 3, ... in ``order``, which should leave no ties."""
    return running_total(df, order, F.lit(1).cast("long"), "_before_id").withColumn(out, F.col("_before_id") + 1).drop("_before_id")


def auc_and_brier(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row ``n, auc, brier``: the chance that a positive outscores a
    negative (ties half), and the mean squared miss. Rows with a null go."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    per = rows.groupBy(F.col(score).alias("_s")).agg(F.sum(truth).cast("double").alias("_p"), F.sum(1 - F.col(truth)).cast("double").alias("_q"))
    per = running_total(per, ["_s"], F.col("_q"), "_below")
    won = per.agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)).alias("_won"), F.sum("_p").alias("_np"), F.sum("_q").alias("_nq"))
    miss = rows.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(score) - F.col(truth), 2)).alias("brier"))
    return miss.crossJoin(F.broadcast(won)).select("n", F.try_divide(F.col("_won"), F.col("_np") * F.col("_nq")).alias("auc"), "brier")  # one row each
