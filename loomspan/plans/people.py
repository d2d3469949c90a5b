"""Record clean-up, cascades and panels of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import similarity as S
from loomspan.functions import text as T
from loomspan.operators import estimators as E
from loomspan.operators import records as D
from loomspan.operators import relational as R
from loomspan.plans.panels import _FLOWS, _SPELLS, flows, nation_years, spells
from loomspan.plans.registry import register, table


@register("like_containment", """SELECT p_partkey, n_name FROM part JOIN nation ON p_name || p_type LIKE '%' || chr(97 + n_nationkey::INTEGER) || '%'""")
def like_containment(spark: SparkSession, d: str) -> DataFrame:
    """A containment condition against a lookup table of 25 rows, broadcast."""
    n = table(spark, d, "nation").select("n_name", F.char(97 + F.col("n_nationkey")).alias("bit"))
    p = table(spark, d, "part").withColumn("t", F.concat("p_name", "p_type"))
    return p.join(F.broadcast(n), F.contains("t", "bit")).select("p_partkey", "n_name")


@register("or_composed_join", """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey
AND (c_custkey % 4 = s_suppkey % 4 OR c_mktsegment = 'BUILDING')""")
def or_composed_join(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    fits = (c.c_custkey % 4 == s.s_suppkey % 4) | (c.c_mktsegment == "BUILDING")
    return c.join(s, (c.c_nationkey == s.s_nationkey) & fits).select("c_custkey", "s_suppkey")


@register("soft_filter_flags", """SELECT *, n >= 2 AND total > 100000 AS pass FROM (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)""")
def soft_filter_flags(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.withColumn("pass", (F.col("n") >= 2) & (F.col("total") > 100000))


@register("duplicate_records", """SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND substr(a.o_orderpriority, 1, 1) = substr(b.o_orderpriority, 1, 1)
AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 90 AND jaro_winkler_similarity(a.o_orderpriority, b.o_orderpriority) >= 0.85""")
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    """A cheap prefix block first; the costly score on what is left."""
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", F.substring("o_orderpriority", 1, 1).alias("p"))
    b = a.select(F.col("o_orderkey").alias("b_key"), F.col("o_custkey").alias("_c"), F.col("o_orderdate").alias("_d"), F.col("o_orderpriority").alias("_o"), F.col("p").alias("_p"))
    near = F.abs(F.datediff("o_orderdate", "_d")) <= 90
    both = a.join(b, (F.col("o_custkey") == F.col("_c")) & (F.col("p") == F.col("_p")) & (F.col("o_orderkey") < F.col("b_key")) & near)
    return both.where(S.jaro_winkler_similarity("o_orderpriority", "_o") >= 0.85).select(F.col("o_orderkey").alias("a_key"), "b_key")


@register("overlap_sweep", f"""WITH {_SPELLS}, s AS (SELECT o_orderkey, o_custkey, year(a) AS x, year(b) AS y FROM sp)
SELECT o_orderkey, coalesce(x <= max(y) OVER (PARTITION BY o_custkey ORDER BY x, y, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0, false) AS overlaps FROM s""")
def overlap_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = spells(spark, d).select("o_orderkey", "o_custkey", F.year("a").alias("x"), F.year("b").alias("y"))
    return D.overlapping_neighbours(s, ["o_custkey"], "x", "y", 0, ["o_orderkey"]).select("o_orderkey", "overlaps")


@register("bounded_after_first", """SELECT a.o_orderkey, b.o_orderkey AS next_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 1 YEAR QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey) = 1""")
def bounded_after_first(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    b = a.select(F.col("o_orderkey").alias("next_key"), F.col("o_custkey").alias("_c"), F.col("o_orderdate").alias("_d"))
    on = (F.col("o_custkey") == F.col("_c")) & (F.col("_d") > F.col("o_orderdate")) & (F.col("_d") <= F.col("o_orderdate") + F.expr("INTERVAL 1 YEAR"))
    return R.first_per(a.join(b, on), ["o_orderkey"], [F.col("_d").asc(), F.col("next_key").asc()]).select("o_orderkey", "next_key")


@register("country_cascade", """WITH a AS (SELECT c_mktsegment || '-' || (c_custkey % 50) AS k, c_nationkey AS v, 3 AS p FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_mktsegment || '-' || (c_custkey % 50) AS k, c_nationkey % 5 AS v, 2 AS p FROM customer),
u AS (SELECT k, min(v) AS v, p FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k, p HAVING min(v) = max(v))
SELECT k, arg_max(v, p) AS v, max(p) AS priority FROM u GROUP BY 1""")
def country_cascade(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("k", F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 50).cast("string")))
    a = c.where("c_custkey % 2 = 0").select("k", F.col("c_nationkey").alias("v"))
    return D.cascade([(a, 3), (c.select("k", (F.col("c_nationkey") % 5).alias("v")), 2)], "k", "v")


@register("status_by_year_wide", f"""WITH {_SPELLS}, g AS (SELECT o_orderkey, year(a) AS x, year(b) AS y, t FROM sp, (SELECT unnest([1995, 1998]) AS t))
SELECT o_orderkey, """ + ", ".join(f"max(CASE WHEN t = {t} THEN CASE WHEN {c} THEN 1 ELSE 0 END END) AS {n}_{t}" for t in (1995, 1998) for n, c in (("before", "t < x"), ("during", "t BETWEEN x AND y"), ("after", "t > y"))) + " FROM g GROUP BY 1")
def status_by_year_wide(spark: SparkSession, d: str) -> DataFrame:
    s = spells(spark, d).select("o_orderkey", F.year("a").alias("x"), F.year("b").alias("y"))
    cols = [D.status_flags(F.col("x"), F.col("y"), F.lit(t))[n].cast("int").alias(f"{n}_{t}") for t in (1995, 1998) for n in ("before", "during", "after")]
    return s.select("o_orderkey", *cols)


@register("birth_year_guess", """SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 1990 + p_size - 18 END, least(1980 + p_size - 18, 1990 + p_size % 7 - 23)) AS born FROM part""")
def birth_year_guess(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", D.birth_year(F.when(s > 40, 1990 + s), 1980 + s, 1990 + s % 7).alias("born"))


@register("pair_correction", f"""WITH {_FLOWS}, f AS (SELECT c, k, t, min(t) OVER (PARTITION BY c) AS a, min(t) OVER (PARTITION BY k) AS b, min(t) OVER (PARTITION BY c, k) AS p FROM fl)
SELECT c, k, t, NOT (t > 1996 AND t = p AND a < t AND b < t) AS keep FROM f""")
def pair_correction(spark: SparkSession, d: str) -> DataFrame:
    return D.new_pairs(flows(spark, d), "c", "k", "t", 1996).select("c", "k", "t", "keep")


@register("exposure_trajectory", f"""WITH {_FLOWS}, g AS (SELECT k, CASE WHEN r IS NOT NULL THEN greatest(0, r) END AS v FROM (SELECT k, q - lag(q) OVER (PARTITION BY k ORDER BY t) AS r FROM bt)),
p AS (SELECT k, sum(v) AS total, max(v) AS peak, avg(CASE WHEN v > 0 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END) AS s FROM g GROUP BY 1),
c AS (SELECT quantile_cont(total, 0.25) AS l, quantile_cont(total, 0.75) AS h FROM p WHERE total > 0)
SELECT k, round(total, 4) AS total, round(peak, 4) AS peak, round(s, 6) AS active_share, CASE WHEN total <= 0 THEN 'none' WHEN total <= l THEN 'low' WHEN total >= h THEN 'high' ELSE 'middle' END AS kind FROM p, c""")
def exposure_trajectory(spark: SparkSession, d: str) -> DataFrame:
    b = flows(spark, d).groupBy("k", "t").agg(F.sum("q").alias("q"))
    rise = F.col("q") - F.lag("q").over(Window.partitionBy("k").orderBy("t"))
    b = b.withColumn("r", rise).withColumn("v", F.when(F.col("r").isNotNull(), F.greatest(F.lit(0.0), F.col("r"))))
    b = b.where("v IS NOT NULL")
    x = D.trajectory(b, "k", "v")
    return x.select("k", F.round("total", 4).alias("total"), F.round("peak", 4).alias("peak"), F.round("active_share", 6).alias("active_share"), "kind")


@register("transition_shares", f"""WITH {_FLOWS}, s AS (SELECT c, k, sum(CASE WHEN t BETWEEN 1995 AND 1997 THEN q ELSE 0 END) AS early, sum(CASE WHEN t BETWEEN 1998 AND 2000 THEN q ELSE 0 END) AS late, sum(q) AS whole FROM fl GROUP BY 1, 2)
SELECT c, k, round(early / nullif(sum(early) OVER w, 0), 6) AS early, round(late / nullif(sum(late) OVER w, 0), 6) AS late, round(whole / nullif(sum(whole) OVER w, 0), 6) AS whole FROM s
WINDOW w AS (PARTITION BY c) QUALIFY count(*) OVER (PARTITION BY c) >= 20""")
def transition_shares(spark: SparkSession, d: str) -> DataFrame:
    w = {"early": (1995, 1997), "late": (1998, 2000), "whole": (0, 9999)}
    s = D.window_shares(flows(spark, d), "c", "k", "t", "q", w, 20)
    return s.select("c", "k", *[F.round(n, 6).alias(n) for n in w])


@register("tenure_panel", f"""WITH {_SPELLS} SELECT c_nationkey, CAST(year(a) AS INTEGER) AS year, count(*) AS n, round(avg(CAST(b AS DATE) - CAST(a AS DATE)), 4) AS mean_days,
round(avg(CASE WHEN CAST(b AS DATE) - CAST(a AS DATE) > 60 THEN 1.0 ELSE 0.0 END), 6) AS long_share FROM sp JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def tenure_panel(spark: SparkSession, d: str) -> DataFrame:
    s = spells(spark, d).withColumn("days", F.datediff("b", "a")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return s.groupBy("c_nationkey", F.year("a").alias("year")).agg(
        F.count("*").alias("n"), F.round(F.avg("days"), 4).alias("mean_days"), F.round(F.avg((F.col("days") > 60).cast("double")), 6).alias("long_share")
    )


@register("summary_table", """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(min(c_acctbal), 2) AS low,
round(median(c_acctbal), 4) AS mid, round(max(c_acctbal), 2) AS high FROM customer GROUP BY 1""")
def summary_table(spark: SparkSession, d: str) -> DataFrame:
    x = "c_acctbal"
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.round(F.min(x), 2).alias("low"),
        F.round(F.median(x), 4).alias("mid"), F.round(F.max(x), 2).alias("high"),
    )


@register("subgroup_effects")
def subgroup_effects(spark: SparkSession, d: str) -> DataFrame:
    """One fit for each of two halves of the nations."""
    n = nation_years(spark, d).withColumn("x", (F.col("t") * F.col("c") % 7).cast("double"))
    rows = []
    for half in (0, 1):
        fit = E.ols(n.where(F.col("c") % 2 == half), "q", ["x"], ["c"], "c")
        rows.append((half, round(float(fit.beta[0]), 6), round(float(fit.se[0]), 6), fit.n))
    return spark.createDataFrame(rows, "half int, beta double, se double, n long")


@register("token_cluster_tfidf", r"""WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part), n AS (SELECT p_partkey, w, count(*) AS tf FROM t GROUP BY 1, 2),
f AS (SELECT w, ln((SELECT count(*) + 1 FROM part) / (count(*) + 1.0)) AS idf FROM n GROUP BY 1)
SELECT p_partkey, w AS token, round(tf * idf, 6) AS weight FROM n JOIN f USING (w)""")
def token_cluster_tfidf(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.explode(T.words(F.lower(F.concat_ws(" ", "p_name", "p_type")))).alias("token"))
    n = p.groupBy("p_partkey", "token").agg(F.count("*").alias("tf"))
    total = table(spark, d, "part").agg((F.count("*") + 1).alias("m"))
    f = n.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # one row
    return n.join(f, "token").select("p_partkey", "token", F.round(F.col("tf") * F.log(F.col("m") / (F.col("df") + 1.0)), 6).alias("weight"))
