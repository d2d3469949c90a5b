"""Estimators on aggregates: the data stay distributed, the driver solves
systems of the size of the regressors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.storage import settle


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """The matrix of (weighted) sums of products of the columns, in one pass."""
    w = F.col(weight) if weight else F.lit(1.0)
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"s{i}_{j}") for i, j in cells]).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in cells:
        out[i, j] = out[j, i] = row[f"s{i}_{j}"] or 0.0
    return out


def drop_singletons(df: DataFrame, effects: list[str], rounds: int = 100) -> DataFrame:
    """Without rows that are alone in a level of an effect, until none is."""
    for _ in range(rounds):
        for g in effects:
            df = df.withColumn(f"_n_{g}", F.count("*").over(Window.partitionBy(g)))
        ns = [f"_n_{g}" for g in effects]
        alone = F.least(*ns) == 1 if len(ns) > 1 else F.col(ns[0]) == 1
        df = settle(df.withColumn("_alone", alone).drop(*ns), "singles")
        if not df.where("_alone").take(1):
            return df.drop("_alone")
        df = df.where("NOT _alone").drop("_alone")
    raise RuntimeError(f"rows alone in an effect are left after {rounds} rounds")


def absorb(df: DataFrame, columns: list[str], effects: list[str], weight: str | None = None, rounds: int = 200, tol: float = 1e-10) -> DataFrame:
    """The columns less the effects' means, by alternating projections; two
    balanced effects need one round."""
    names = [f"_r_{c}" for c in columns]
    df = df.select("*", *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    w = F.col(weight) if weight else F.lit(1.0)
    for turn in range(rounds):
        moved = F.lit(0.0)
        for g in effects:
            part = Window.partitionBy(g)
            means = [F.sum(w * F.col(n)).over(part) / F.sum(w).over(part) for n in names]
            df = df.select(*[c for c in df.columns if c not in names], *names, *[m.alias(f"_m{i}") for i, m in enumerate(means)])
            shift = F.greatest(F.lit(0.0), *[F.abs(F.col(f"_m{i}")) for i in range(len(names))])
            if len(effects) > 1 or turn == 0:
                moved = shift if g == effects[0] else F.greatest(F.col("_moved"), shift)
            df = df.withColumn("_moved", moved)
            for i, n in enumerate(names):
                df = df.withColumn(n, F.col(n) - F.col(f"_m{i}"))
            df = df.drop(*[f"_m{i}" for i in range(len(names))])
        if len(effects) == 1:
            return df.drop("_moved")
        df = settle(df, "absorbed")
        if turn and (df.agg(F.max("_moved")).first()[0] or 0.0) < tol:
            return df.drop("_moved")
    raise RuntimeError(f"the effects' means did not settle in {rounds} rounds")


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    n: int
    clusters: int

    def rows(self) -> list[tuple[str, float, float, int, int]]:
        return [(k, float(b), float(s), self.n, self.clusters) for k, b, s in zip(self.names, self.beta, self.se, strict=True)]


def _meat(df: DataFrame, xs: list[str], resid: Column, cluster: str, weight: str | None) -> tuple[np.ndarray, int, int]:
    w = F.col(weight) if weight else F.lit(1.0)
    scores = df.withColumn("_e", resid).groupBy(cluster).agg(*[F.sum(w * F.col(x) * F.col("_e")).alias(f"_s{i}") for i, x in enumerate(xs)], F.count("*").alias("_n"))
    scores = scores.withColumn("_one", F.lit(1.0))
    names = [f"_s{i}" for i in range(len(xs))]
    row = scores.agg(F.count("*").alias("g"), F.sum("_n").alias("n")).first()
    return gram(scores, names), int(row["g"]), int(row["n"])


def ols(df: DataFrame, y: str, xs: list[str], effects: list[str], cluster: str, weight: str | None = None) -> Fit:
    """Least squares with absorbed effects and cluster-robust errors (CRV1).

    Effects nested in the cluster don't count as parameters; the others count
    by their levels less one. Rows with a null in any column go first.
    """
    df = df.dropna(subset=[y, *xs, *effects, cluster, *([weight] if weight else [])])
    if effects:
        df = absorb(drop_singletons(df, effects), [y, *xs], effects, weight)
        cols = [f"_r_{c}" for c in (y, *xs)]
    else:
        df = df.withColumn("_one", F.lit(1.0))
        cols, xs = [y, *xs, "_one"], [*xs, "_one"]
    whole = gram(df, cols, weight)
    bread = np.linalg.pinv(whole[1:, 1:])
    beta = bread @ whole[1:, 0]
    resid = F.col(cols[0])
    for b, c in zip(beta, cols[1:], strict=True):
        resid = resid - float(b) * F.col(c)
    meat, g, n = _meat(df, cols[1:], resid, cluster, weight)
    k = len(xs)
    for e in effects:
        if e != cluster:
            k += df.select(e).distinct().count() - 1
    small = g / max(1, g - 1) * (n - 1) / max(1, n - k)
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread) * small, 0))
    return Fit(xs, beta, se, n, g)


def _independent(df: DataFrame, columns: list[str], whole: np.ndarray) -> list[bool]:
    """For each column whether it varies beyond the effects and the columns
    kept before it; ``whole`` holds the sums of products of what is left."""
    raw = df.agg(*[F.sum(F.pow(F.col(c).cast("double"), 2)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    kept: list[int] = []
    for i in range(len(columns)):
        own = rest = whole[i, i]
        if kept:
            rest = own - whole[i, kept] @ np.linalg.solve(whole[np.ix_(kept, kept)], whole[kept, i])
        if own > 1e-18 * (raw[i] or 0.0) and rest > 1e-12 * own:
            kept.append(i)
    return [i in kept for i in range(len(columns))]


def iv(df: DataFrame, y: str, endog: str, instrument: str, exog: list[str], effects: list[str], cluster: str) -> tuple[Fit, float]:
    """Two-stage least squares with one endogenous regressor, and the first
    stage's F of the instrument.

    Exogenous regressors that the effects or earlier ones determine are left
    out: their estimates are NaN. An instrument that they determine raises.
    """
    df = absorb(drop_singletons(df.dropna(subset=[y, endog, instrument, *exog, *effects, cluster]), effects), [y, endog, instrument, *exog], effects)
    r = lambda c: f"_r_{c}"
    named, order = [endog, *exog], [*exog, instrument]
    free = _independent(df, order, gram(df, [r(c) for c in order]))
    if not free[-1]:
        raise ValueError(f"{instrument} does not vary beyond the effects and the exogenous regressors")
    exog = [c for c, keep in zip(exog, free, strict=False) if keep]
    zs, xs = [r(instrument), *map(r, exog)], [r(endog), *map(r, exog)]
    whole = gram(df, [r(y), *xs, r(instrument)])
    at = {c: i for i, c in enumerate([r(y), *xs, r(instrument)])}
    zx = np.array([[whole[at[z], at[x]] for x in xs] for z in zs])
    zy = np.array([whole[at[z], 0] for z in zs])
    beta = np.linalg.solve(zx, zy)
    resid = F.col(r(y))
    for b, x in zip(beta, xs, strict=True):
        resid = resid - float(b) * F.col(x)
    meat, g, n = _meat(df, zs, resid, cluster, None)
    bread = np.linalg.inv(zx)
    small = g / max(1, g - 1) * (n - 1) / max(1, n - len(xs))
    se = np.sqrt(np.diag(bread @ meat @ bread.T) * small)
    zz = np.array([[whole[at[a], at[b]] for b in zs] for a in zs])
    pi = np.linalg.solve(zz, np.array([whole[at[z], at[r(endog)]] for z in zs]))
    first = F.col(r(endog))
    for p, z in zip(pi, zs, strict=True):
        first = first - float(p) * F.col(z)
    m1, g, n = _meat(df, zs, first, cluster, None)
    v = (np.linalg.inv(zz) @ m1 @ np.linalg.inv(zz))[0, 0] * g / max(1, g - 1) * (n - 1) / max(1, n - len(zs))
    at = {c: i for i, c in enumerate([endog, *exog])}
    all_of = lambda found: np.array([found[at[c]] if c in at else np.nan for c in named])
    return Fit(named, all_of(beta), all_of(se), n, g), float(pi[0] ** 2 / v)


def ppml(df: DataFrame, y: str, xs: list[str], effect: str, cluster: str, rounds: int = 50, tol: float = 1e-9) -> Fit:
    """Conditional Poisson: each group's effect is concentrated out, which
    leaves Newton steps on weighted within-group moments. Groups without any
    outcome go."""
    df = df.dropna(subset=[y, *xs, effect, cluster])
    part = Window.partitionBy(effect)
    df = settle(df.withColumn("_y", F.sum(y).over(part)).where("_y > 0"), "ppml")
    beta = np.zeros(len(xs))
    bread = np.eye(len(xs))

    def weighted() -> DataFrame:
        eta = F.lit(0.0)
        for b, x in zip(beta, xs, strict=True):
            eta = eta + float(b) * F.col(x)
        out = df.withColumn("_e", F.exp(eta))
        out = out.withColumn("_mu", F.col("_y") * F.col("_e") / F.sum("_e").over(part))
        for i, x in enumerate(xs):
            out = out.withColumn(f"_d{i}", F.col(x) - F.sum(F.col("_mu") * F.col(x)).over(part) / F.col("_y"))
        return out.withColumn("_u", F.col(y) - F.col("_mu"))

    ds = [f"_d{i}" for i in range(len(xs))]
    for _ in range(rounds):
        now = weighted()
        cells = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
        row = now.agg(*[F.sum(F.col(d) * F.col("_u")).alias(f"g{i}") for i, d in enumerate(ds)], *[F.sum(F.col("_mu") * F.col(ds[i]) * F.col(ds[j])).alias(f"h{i}_{j}") for i, j in cells]).first()
        h = np.zeros((len(xs), len(xs)))
        for i, j in cells:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        bread = np.linalg.pinv(h)
        step = bread @ np.array([row[f"g{i}"] for i in range(len(xs))])
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    else:
        raise RuntimeError(f"the Newton steps did not settle in {rounds} rounds")
    meat, g, n = _meat(weighted(), ds, F.col("_u"), cluster, None)
    se = np.sqrt(np.diag(bread @ meat @ bread) * g / max(1, g - 1))
    return Fit(xs, beta, se, n, g)


def shock_errors(share: DataFrame, resid: DataFrame, shift: DataFrame, unit: str, shock: str, time: str, z: str, e: str, g: str) -> float:
    """The square root of the sum over shocks of (sum of share * shock * e)
    squared, over the sum of z squared: shocks, not units, are independent."""
    part = share.join(shift, shock).join(resid.select(unit, time, e), [unit, time])
    per = part.groupBy(shock).agg(F.sum(F.col("share") * F.col(g) * F.col(e)).alias("_s"))
    top = per.agg(F.sum(F.col("_s") * F.col("_s"))).first()[0] or 0.0
    return math.sqrt(top) / (resid.agg(F.sum(F.col(z) * F.col(z))).first()[0] or math.nan)


def did_2x2(df: DataFrame, treated: Column, post: Column, y: str) -> Column:
    """An aggregate: the difference of the differences of means."""
    mean = lambda t, p: F.avg(F.when(t & p, F.col(y)))
    return mean(treated, post) - mean(treated, ~post) - mean(~treated, post) + mean(~treated, ~post)


def cohort_effects(df: DataFrame, unit: str, time: str, y: str, event: str) -> DataFrame:
    """``cohort, rel, att, n``: for each cohort and time, its change since the
    year before its event less that of the never treated; n treated units."""
    cohorts = df.where(F.col(event).isNotNull()).select(F.col(event).alias("cohort")).distinct()
    base = df.select(F.col(unit).alias("_u"), F.col(time).alias("_b"), F.col(y).alias("_y0"))
    own = df.where(F.col(event).isNotNull()).withColumn("cohort", F.col(event)).withColumn("_t", F.lit(1))
    never = df.where(F.col(event).isNull()).crossJoin(F.broadcast(cohorts)).withColumn("_t", F.lit(0))  # a cohort is a year
    both = own.unionByName(never.select(*own.columns))
    both = both.join(base, (F.col(unit) == F.col("_u")) & (F.col("_b") == F.col("cohort") - 1)).withColumn("_d", F.col(y) - F.col("_y0"))
    out = both.groupBy("cohort", (F.col(time) - F.col("cohort")).alias("rel")).agg(
        (F.avg(F.when(F.col("_t") == 1, F.col("_d"))) - F.avg(F.when(F.col("_t") == 0, F.col("_d")))).alias("att"), F.sum("_t").alias("n")
    )
    return out.where("n > 0 AND att IS NOT NULL")


def dynamic(effects: DataFrame) -> DataFrame:
    """``rel, att, n``: cohort effects averaged by treated units."""
    return effects.groupBy("rel").agg((F.sum(F.col("att") * F.col("n")) / F.sum("n")).alias("att"), F.sum("n").alias("n"))


def sun_abraham(df: DataFrame, unit: str, time: str, y: str, event: str, low: int, high: int) -> list[tuple[int, float]]:
    """Interaction-weighted event-time effects: cohort by relative-time
    dummies with unit and time effects, averaged by cohort sizes."""
    rel = F.col(time) - F.col(event)
    df = df.withColumn("_rel", F.least(F.greatest(rel, F.lit(low)), F.lit(high)))
    cells = sorted((r[0], r[1], r[2]) for r in df.where(F.col(event).isNotNull() & (F.col("_rel") != -1)).groupBy(event, "_rel").agg(F.count_distinct(unit)).collect())
    names = []
    for i, (g, r, _) in enumerate(cells):
        names.append(f"_c{i}")
        df = df.withColumn(names[-1], F.coalesce(((F.col(event) == g) & (F.col("_rel") == r)).cast("double"), F.lit(0.0)))
    done = absorb(df, [y, *names], [unit, time])
    whole = gram(done, [f"_r_{c}" for c in (y, *names)])
    beta = np.linalg.pinv(whole[1:, 1:], rcond=1e-10) @ whole[1:, 0]
    out = []
    for r in sorted({c[1] for c in cells}):
        own = [(b, n) for b, (_, q, n) in zip(beta, cells, strict=True) if q == r]
        out.append((int(r), float(sum(b * n for b, n in own) / sum(n for _, n in own))))
    return out


def did2s(df: DataFrame, unit: str, time: str, y: str, event: str) -> DataFrame:
    """``rel, att``: effects of unit and time fitted on rows not yet treated,
    then means of what they leave. Balanced untreated years make the fit the
    means by time of the never treated plus each unit's own difference."""
    never = df.where(F.col(event).isNull()).groupBy(time).agg(F.avg(y).alias("_l"))
    both = df.join(never, time).withColumn("_g", F.col(y) - F.col("_l"))
    before = F.col(event).isNull() | (F.col(time) < F.col(event))
    both = both.withColumn("_a", F.avg(F.when(before, F.col("_g"))).over(Window.partitionBy(unit)))
    own = both.where(F.col(event).isNotNull()).withColumn("rel", F.col(time) - F.col(event))
    return own.groupBy("rel").agg(F.avg(F.col("_g") - F.col("_a")).alias("att"))


def balance(df: DataFrame, arm: Column, columns: list[str]) -> DataFrame:
    """``variable, treated, control, smd``: means by arm, and their difference
    over the pooled standard deviation."""
    long = df.select(arm.cast("int").alias("_arm"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_x"))
    long = long.select("_arm", "_x.variable", "_x.v")
    on = lambda f, a: f(F.when(F.col("_arm") == a, F.col("v")))
    spread = F.sqrt((on(F.var_samp, 1) + on(F.var_samp, 0)) / 2)
    return long.groupBy("variable").agg(on(F.avg, 1).alias("treated"), on(F.avg, 0).alias("control"), F.try_divide(on(F.avg, 1) - on(F.avg, 0), spread).alias("smd"))


def spearman(df: DataFrame, x: str, y: str) -> Column:
    """The correlation of average ranks; use on ``with_ranks`` columns."""
    return F.corr(f"_rank_{x}", f"_rank_{y}")


def with_ranks(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Adds ``_rank_<column>``: average ranks within ``keys``."""
    for c in columns:
        part = Window.partitionBy(*keys)
        df = df.withColumn(f"_rank_{c}", F.rank().over(part.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2)
    return df


def bootstrap_weight(cluster: Column, draw: Column) -> Column:
    """A Poisson(1) weight of a cluster in a draw, from a hash: the same each time."""
    u = F.pmod(F.xxhash64(cluster, draw), F.lit(1_000_003)) / 1_000_003.0
    out, total, p = F.lit(8), 0.0, math.exp(-1)
    steps = []
    for k in range(8):
        total += p
        steps.append((total, k))
        p /= k + 1
    for total, k in reversed(steps):
        out = F.when(u < total, k).otherwise(out)
    return out


def propensity(df: DataFrame, label: str, features: list[str], prediction: str = "p") -> DataFrame:
    """Adds a logit's probability: medians for nulls, standardised features,
    a slight ridge."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = df.select("*", *[F.col(c).cast("double").alias(f"_f_{c}") for c in features])
    steps = [
        Imputer(strategy="median", inputCols=[f"_f_{c}" for c in features], outputCols=[f"_i_{c}" for c in features]),
        VectorAssembler(inputCols=[f"_i_{c}" for c in features], outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_s", withMean=True),
        LogisticRegression(featuresCol="_s", labelCol=label, regParam=1e-4, maxIter=50),
    ]
    out = Pipeline(stages=steps).fit(df).transform(df)
    out = out.withColumn(prediction, vector_to_array("probability")[1])
    return out.drop("_v", "_s", "rawPrediction", "probability", "prediction", *[f"_f_{c}" for c in features], *[f"_i_{c}" for c in features])


def trim(df: DataFrame, arm: str, p: str) -> DataFrame:
    """Rows on the common support of both arms' scores."""
    ends = df.groupBy(arm).agg(F.min(p).alias("_a"), F.max(p).alias("_b")).agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    return df.crossJoin(F.broadcast(ends)).where(F.col(p).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # one row
