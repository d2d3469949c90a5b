"""Estimators on panels made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import estimators as E
from loomspan.operators import panel as P
from loomspan.plans.panels import _EVENTS, _FLOWS, brand_years, flows, nation_events, nation_years
from loomspan.plans.registry import register, table

_RESULT = "term string, beta double, se double, n long, clusters long"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """Nation-years with an outcome, an instrument and its target."""
    f = flows(spark, d)
    share = P.shares(f.where("t <= 1996"), "c", "k", "q")
    shift = P.growth(f.groupBy("k", "t").agg(F.sum("q").alias("q")), "k", "t", "q")
    z = P.shift_share(share, shift, "c", "k", "t", ["g_level"]).withColumnRenamed("z_g_level", "z")
    n = f.groupBy("c", "t").agg(F.sum("q").alias("y"), F.count_distinct("k").cast("double").alias("brands"))
    order = Window.partitionBy("c").orderBy("t")
    n = n.withColumn("x", F.col("y") - F.lag("y").over(order))
    return n.join(z, ["c", "t"]).dropna()


def _result(spark: SparkSession, fit: E.Fit) -> DataFrame:
    rows = spark.createDataFrame(fit.rows(), _RESULT).replace(float("nan"), None, ["beta", "se"])  # regressors left out
    return rows.withColumn("beta", F.round("beta", 6)).withColumn("se", F.round("se", 6))


_BAL = f"""WITH {_FLOWS}, a AS (SELECT c, t, q AS y, CAST(t * c % 7 AS DOUBLE) AS x FROM nt WHERE c IN (SELECT c FROM nt WHERE t BETWEEN 1996 AND 2000 GROUP BY c HAVING count(*) = 5) AND t BETWEEN 1996 AND 2000),
r AS (SELECT y - avg(y) OVER (PARTITION BY c) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, x - avg(x) OVER (PARTITION BY c) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS x FROM a)"""


def _balanced(spark: SparkSession, d: str) -> DataFrame:
    n = nation_years(spark, d).where("t BETWEEN 1996 AND 2000")
    return P.balanced(n, "c", "t", 5).select("c", "t", F.col("q").alias("y"), (F.col("t") * F.col("c") % 7).cast("double").alias("x"))


@register("ols_twfe", f"{_BAL} SELECT 'x' AS term, round(sum(x * y) / sum(x * x), 6) AS beta, count(*) AS n FROM r")
def ols_twfe(spark: SparkSession, d: str) -> DataFrame:
    return _result(spark, E.ols(_balanced(spark, d), "y", ["x"], ["c", "t"], "c")).select("term", "beta", "n")


@register("ols_crv1")
def ols_crv1(spark: SparkSession, d: str) -> DataFrame:
    return _result(spark, E.ols(_panel(spark, d), "y", ["z", "brands"], ["c", "t"], "c"))


@register("wls_fe")
def wls_fe(spark: SparkSession, d: str) -> DataFrame:
    return _result(spark, E.ols(_panel(spark, d), "y", ["z"], ["c", "t"], "c", weight="brands"))


@register("iv_2sls")
def iv_2sls(spark: SparkSession, d: str) -> DataFrame:
    fit, first = E.iv(_panel(spark, d), "y", "x", "z", ["brands"], ["c", "t"], "c")
    return _result(spark, fit).withColumn("first_stage_f", F.lit(round(first, 6)))


@register("ppml")
def ppml(spark: SparkSession, d: str) -> DataFrame:
    return _result(spark, E.ppml(_balanced(spark, d), "y", ["x"], "c", "c"))


@register("shock_score_se")
def shock_score_se(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    share = P.shares(f.where("t <= 1996"), "c", "k", "q")
    shift = P.growth(f.groupBy("k", "t").agg(F.sum("q").alias("q")), "k", "t", "q").select("k", "t", F.col("g_level").alias("g"))
    r = E.absorb(_panel(spark, d), ["y", "z"], ["c", "t"])
    g = E.gram(r, ["_r_y", "_r_z"])
    beta = g[0, 1] / g[1, 1]
    r = r.select("c", "t", F.col("_r_z").alias("zr"), (F.col("_r_y") - float(beta) * F.col("_r_z")).alias("e"))
    se = E.shock_errors(share, r, shift, "c", "k", "t", "zr", "e", "g")
    return spark.createDataFrame([("z", round(float(beta), 6), round(se, 6))], "term string, beta double, shock_se double")


@register("sun_abraham")
def sun_abraham(spark: SparkSession, d: str) -> DataFrame:
    p = nation_years(spark, d).join(nation_events(spark, d), "c", "left").withColumn("q", F.col("q").cast("double"))
    return spark.createDataFrame([(r, round(b, 6)) for r, b in E.sun_abraham(p, "c", "t", "q", "event_time", -3, 3)], "rel int, att double")


@register("did_2x2", f"""WITH {_EVENTS}, p AS (SELECT nt.c, t, q, event_time IS NOT NULL AS tr, t >= 1996 AS po FROM nt LEFT JOIN ev ON ev.c = nt.c)
SELECT round(avg(CASE WHEN tr AND po THEN q END) - avg(CASE WHEN tr AND NOT po THEN q END) - avg(CASE WHEN NOT tr AND po THEN q END) + avg(CASE WHEN NOT tr AND NOT po THEN q END), 4) AS did FROM p""")
def did_2x2(spark: SparkSession, d: str) -> DataFrame:
    p = nation_years(spark, d).join(nation_events(spark, d), "c", "left")
    return p.agg(F.round(E.did_2x2(p, F.col("event_time").isNotNull(), F.col("t") >= 1996, "q"), 4).alias("did"))


_ATT = f"""WITH {_EVENTS}, p AS (SELECT nt.c, t, q, event_time FROM nt LEFT JOIN ev ON ev.c = nt.c),
g AS (SELECT DISTINCT event_time AS cohort FROM p WHERE event_time IS NOT NULL),
r AS (SELECT cohort, p.t - cohort AS rel, p.q - b.q AS d, event_time IS NOT NULL AS tr FROM p JOIN g ON event_time = cohort OR event_time IS NULL
  JOIN nt b ON b.c = p.c AND b.t = cohort - 1),
a AS (SELECT cohort, rel, avg(d) FILTER (WHERE tr) - avg(d) FILTER (WHERE NOT tr) AS att, count(*) FILTER (WHERE tr) AS n FROM r GROUP BY 1, 2)"""


@register("callaway_cohorts", f"{_ATT} SELECT cohort, rel, round(att, 4) AS att, n FROM a WHERE n > 0 AND att IS NOT NULL")
def callaway_cohorts(spark: SparkSession, d: str) -> DataFrame:
    p = nation_years(spark, d).join(nation_events(spark, d), "c", "left")
    return E.cohort_effects(p, "c", "t", "q", "event_time").select("cohort", "rel", F.round("att", 4).alias("att"), "n")


@register("callaway_dynamic", f"{_ATT} SELECT rel, round(sum(att * n) / sum(n), 4) AS att, CAST(sum(n) AS BIGINT) AS n FROM a WHERE n > 0 AND att IS NOT NULL GROUP BY 1")
def callaway_dynamic(spark: SparkSession, d: str) -> DataFrame:
    p = nation_years(spark, d).join(nation_events(spark, d), "c", "left")
    return E.dynamic(E.cohort_effects(p, "c", "t", "q", "event_time")).select("rel", F.round("att", 4).alias("att"), "n")


@register("did2s_profile", f"""WITH {_EVENTS}, p AS (SELECT nt.c, t, q, event_time FROM nt LEFT JOIN ev ON ev.c = nt.c),
l AS (SELECT t, avg(q) AS l FROM p WHERE event_time IS NULL GROUP BY 1),
g AS (SELECT c, t, event_time, q - l AS g, avg(CASE WHEN event_time IS NULL OR t < event_time THEN q - l END) OVER (PARTITION BY c) AS a FROM p JOIN l USING (t))
SELECT t - event_time AS rel, round(avg(g - a), 4) AS att FROM g WHERE event_time IS NOT NULL GROUP BY 1""")
def did2s_profile(spark: SparkSession, d: str) -> DataFrame:
    p = nation_years(spark, d).join(nation_events(spark, d), "c", "left")
    return E.did2s(p, "c", "t", "q", "event_time").select("rel", F.round("att", 4).alias("att"))


@register("balance_table", """WITH x AS (SELECT p_brand = 'Brand#11' OR p_size > 25 AS arm, unnest(['p_size', 'p_retailprice']) AS variable, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part)
SELECT variable, round(avg(v) FILTER (WHERE arm), 4) AS treated, round(avg(v) FILTER (WHERE NOT arm), 4) AS control,
round((avg(v) FILTER (WHERE arm) - avg(v) FILTER (WHERE NOT arm)) / sqrt((var_samp(v) FILTER (WHERE arm) + var_samp(v) FILTER (WHERE NOT arm)) / 2), 6) AS smd FROM x GROUP BY 1""")
def balance_table(spark: SparkSession, d: str) -> DataFrame:
    arm = (F.col("p_brand") == "Brand#11") | (F.col("p_size") > 25)
    b = E.balance(table(spark, d, "part"), arm, ["p_size", "p_retailprice"])
    return b.select("variable", F.round("treated", 4).alias("treated"), F.round("control", 4).alias("control"), F.round("smd", 6).alias("smd"))


@register("correlations", """WITH r AS (SELECT p_brand, p_size, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT p_brand, round(corr(p_size, p_retailprice), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    r = E.with_ranks(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_brand"])
    return r.groupBy("p_brand").agg(F.round(F.corr("p_size", "p_retailprice"), 6).alias("pearson"), F.round(E.spearman(r, "p_size", "p_retailprice"), 6).alias("spearman"))


@register("cluster_bootstrap")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = brand_years(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(50))))
    p = p.withColumn("w", E.bootstrap_weight(F.col("k"), F.col("draw")))
    return p.groupBy("draw").agg(F.round(F.try_divide(F.sum(F.col("w") * F.col("q")), F.sum("w")), 4).alias("mean"))


@register("propensity_logit")
def propensity_logit(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "_id")
    x = docs.join(labels, F.col("doc_id") == F.col("_id")).select(
        "doc_id", "quality", F.log1p("n_chars").alias("size"), (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.length("text")).alias("upper"), (F.regexp_count("text", F.lit(r"[|#$%&*]")) / F.length("text")).alias("marks")
    )
    p = E.propensity(x, "quality", ["size", "upper", "marks"])
    return E.trim(p, "quality", "p").select("doc_id", "quality", F.round("p", 6).alias("p"))
