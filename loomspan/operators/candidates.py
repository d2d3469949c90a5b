"""Chains over candidate pairs: paths, gates, country scores, blends, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import similarity as S
from loomspan.functions.text import words
from loomspan.functions.values import ratio
from loomspan.storage import settle


def best_path(paths: list[tuple[DataFrame, str]], keys: list[str], score: str) -> DataFrame:
    """``keys, score, path``: of pairs that several paths propose the best
    score, clipped to 0 to 1; ties go to the path that is named first. A null
    score proposes nothing."""
    rows = None
    for at, (df, name) in enumerate(paths):
        part = df.where(F.col(score).isNotNull()).select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double"))).alias(score), F.lit(-at).alias("_at"), F.lit(name).alias("path"))
        rows = part if rows is None else rows.unionByName(part)
    best = F.max(F.struct(F.col(score), F.col("_at"), F.col("path"))).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, F.col(f"_best.{score}").alias(score), F.col("_best.path").alias("path"))


def alias_gate(name: Column, alias: Column, likeness: float = 0.92, overlap: float = 0.5, shared: int = 2) -> Column:
    """Whether an alias stands for a name: alike letter by letter, or enough
    words shared, both as a share of the shorter and as a number. The costly
    likeness is asked only where the words don't settle it."""
    a, b = F.array_distinct(words(name)), F.array_distinct(words(alias))
    both = F.size(F.array_intersect(a, b))
    settled = (both >= shared) & (both >= overlap * F.least(F.size(a), F.size(b)))
    return F.coalesce(F.when(settled, True).otherwise(S.jaro_winkler_similarity(name, alias) >= likeness), F.lit(False))


def country_score(school: Column, job: Column, region: Column, name: Column, alpha: float) -> Column:
    """The best of three kinds of evidence for a country: a school's, a job's,
    and the name's, of which the subregion counts ``alpha`` and the rest is the
    country's part of its subregion, at most 1. Null evidence counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    part = F.least(F.lit(1.0), zero(name) / F.greatest(zero(region), F.lit(0.01)))
    return F.greatest(zero(school), zero(job), alpha * zero(region) + (1 - alpha) * part)


def crowding_blend(long: DataFrame, key: str, option: str, first: str, second: str, crowd: Column, limit: float, weights: tuple[float, float], crowded: tuple[float, float]) -> DataFrame:
    """``key, option, score, pressure``: two sets of option shares, normalised
    by key, blended by ``weights``; by ``crowded`` where the options that
    ``crowd`` holds for take more than ``limit`` of the first set."""
    part = Window.partitionBy(key)
    share = lambda c: F.coalesce(ratio(F.col(c), F.sum(c).over(part)), F.lit(0.0))
    rows = long.withColumn("_a", share(first)).withColumn("_b", share(second))
    rows = rows.withColumn("pressure", F.coalesce(F.sum(F.when(crowd, F.col("_a"))).over(part), F.lit(0.0)))
    blend = lambda w: w[0] * F.col("_a") + w[1] * F.col("_b")
    rows = rows.withColumn("_s", F.when(F.col("pressure") > limit, blend(crowded)).otherwise(blend(weights)))
    return rows.withColumn("score", share("_s")).select(key, option, "score", "pressure")


def standard_country(raw: Column, known: Column, unknown: str = "Invalid Country") -> Column:
    """A looked-up name; a text that is in no lookup passes through trimmed,
    an empty one is ``unknown``."""
    plain = F.trim(raw)
    return F.coalesce(known, F.when(F.coalesce(plain, F.lit("")) == "", unknown).otherwise(plain))


def control_pool(treated: DataFrame, pool: DataFrame, events: DataFrame, block: list[str], unit: str, time: str, gap: int) -> DataFrame:
    """``unit, time, control``: units of the same block that are not the
    treated one and have no event within ``gap`` of its time. Blocks bound
    the join; the events are looked up by unit and time."""
    a = treated.select(*block, unit, time)
    b = pool.select(*block, F.col(unit).alias("control")).distinct()
    both = a.join(b, block).where(F.col(unit) != F.col("control"))
    near = events.select(F.col(unit).alias("control"), F.explode(F.sequence(F.col(time) - gap, F.col(time) + gap)).alias(time)).distinct()
    return both.join(near, ["control", time], "left_anti").select(unit, time, "control")


def gazetteer_hits(texts: DataFrame, key: str, text: str, places: DataFrame, place: str, most: int = 8) -> DataFrame:
    """``key, place, n_words, at``: runs of one to ``most`` words that are in
    the gazetteer; of hits that begin at one word the longest. The gazetteer is
    written first: Spark sends it to the runs where its size allows."""
    listed = settle(places.select(F.lower(F.col(place)).alias("gram"), F.col(place).alias("place")).distinct(), "places")
    w = texts.repartition(key).select(key, words(F.lower(F.col(text))).alias("_w")).where(F.size("_w") > 0)
    starts = w.select(key, "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("at"))
    runs = starts.select(key, "_w", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("_w") - F.col("at") + 1))).alias("n_words"))
    found = runs.select(key, "at", "n_words", F.array_join(F.slice("_w", F.col("at"), F.col("n_words")), " ").alias("gram")).join(listed, "gram")
    order = Window.partitionBy(key, "at").orderBy(F.col("n_words").desc(), "place")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(key, "place", "n_words", "at")


def weighted_f1(tokens: DataFrame, catalogue: DataFrame, key: str, entry: str, penalty: float) -> DataFrame:
    """``key, entry, score``: texts against the entries of a catalogue by
    shared token weight: F1 of the weight found on either side, less
    ``penalty`` for each token of the entry that is missing. Both frames have
    a row for each token and its weight."""
    total = lambda df, k, out: df.groupBy(k).agg(F.sum("weight").alias(out), F.count("*").cast("double").alias(f"{out}_n"))
    both = tokens.join(catalogue.select(entry, "token"), "token").groupBy(key, entry).agg(F.sum("weight").alias("_w"), F.count("*").alias("_k"))
    both = both.join(total(tokens, key, "_a"), key).join(total(catalogue, entry, "_b"), entry)
    f1 = ratio(2 * F.col("_w"), F.col("_a") + F.col("_b"))
    return both.select(key, entry, (f1 - penalty * (F.col("_b_n") - F.col("_k"))).alias("score"))


def acronym(text: Column) -> Column:
    """The first letters of the words, in upper case."""
    return F.upper(F.array_join(F.transform(words(text), lambda w: F.left(w, F.lit(1))), ""))


def growth_family(df: DataFrame, unit: str, time: str, size: str, base: tuple[int, int], lead: int = 4) -> DataFrame:
    """Measures of a unit's changing size over a gapless panel: ``pulse`` (this
    year's rise), ``step`` (1 from the first rise on), ``cumulative`` (all
    rises so far), ``relative`` (to the mean of the base years) and
    ``placebo`` (the pulse ``lead`` years on)."""
    order = Window.partitionBy(unit).orderBy(time)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rise = F.greatest(F.lit(0.0), F.coalesce(F.col(size) - F.lag(size).over(order), F.lit(0.0)).cast("double"))
    df = df.withColumn("pulse", rise)
    df = df.withColumn("cumulative", F.sum("pulse").over(so_far)).withColumn("step", (F.max("pulse").over(so_far) > 0).cast("int"))
    mean = F.avg(F.when(F.col(time).between(*base), F.col(size))).over(Window.partitionBy(unit))
    return df.withColumn("relative", ratio(F.col(size), mean)).withColumn("placebo", F.lead("pulse", lead).over(order))


def verified(events: DataFrame, outside: DataFrame, unit: str, time: str, gap: int = 3) -> DataFrame:
    """Events with ``source_time`` and ``distance`` of the nearest report from
    outside within ``gap`` years (earlier ones first in a tie) and ``source``:
    'both', 'own', or 'outside' for reports that no event is near."""
    report = outside.select(F.col(unit).alias("_u"), F.col(time).alias("source_time")).distinct()
    keyed = events.select(unit, time).distinct()
    both = keyed.join(report, (F.col(unit) == F.col("_u")) & F.col("source_time").between(F.col(time) - gap, F.col(time) + gap), "left").drop("_u")
    both = both.withColumn("distance", F.abs(F.col("source_time") - F.col(time)))
    order = Window.partitionBy(unit, time).orderBy(F.col("distance").asc_nulls_last(), "source_time")
    own = both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    own = own.withColumn("source", F.when(F.col("distance").isNull(), "own").otherwise("both"))
    near = (F.col("_u") == F.col("_e")) & F.col("source_time").between(F.col("_t") - gap, F.col("_t") + gap)
    alone = report.join(keyed.select(F.col(unit).alias("_e"), F.col(time).alias("_t")), near, "left_anti")
    alone = alone.select(F.col("_u").alias(unit), F.lit(None).cast(dict(events.dtypes)[time]).alias(time), "source_time", F.lit(None).cast("int").alias("distance"), F.lit("outside").alias("source"))
    return own.select(unit, time, "source_time", F.col("distance").cast("int").alias("distance"), "source").unionByName(alone)
