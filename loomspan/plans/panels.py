"""Spells, dense panels, frames, shift shares and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import panel as P
from loomspan.plans.registry import register, table

_FLOWS = """fl AS (SELECT s_nationkey AS c, p_brand AS k, CAST(year(l_shipdate) AS INTEGER) AS t, sum(l_quantity) AS q FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
bt AS (SELECT k, t, sum(q) AS q FROM fl GROUP BY 1, 2), nt AS (SELECT c, t, sum(q) AS q FROM fl GROUP BY 1, 2)"""


def flows(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", F.year("l_shipdate").alias("t"))  # noqa: E741
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("k"))
    both = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("c", "k", "t").agg(F.sum("l_quantity").alias("q"))


def brand_years(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).groupBy("k", "t").agg(F.sum("q").alias("q"))


def nation_years(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).groupBy("c", "t").agg(F.sum("q").alias("q"))


@register("shift_share_z", f"""WITH {_FLOWS}, b AS (SELECT c, k, sum(q) AS x FROM fl WHERE t <= 1996 GROUP BY 1, 2),
s AS (SELECT c, k, x / sum(x) OVER (PARTITION BY c) AS share FROM b),
g AS (SELECT k, t, q - lag(q) OVER w AS g_level, asinh(q) - asinh(lag(q) OVER w) AS g_asinh FROM bt WINDOW w AS (PARTITION BY k ORDER BY t))
SELECT c, t, round(sum(share * g_level), 4) AS z_level, round(sum(share * g_asinh), 6) AS z_asinh,
count(*) FILTER (WHERE share > 0 AND coalesce(g_level, 0) <> 0) AS active FROM s JOIN g USING (k) GROUP BY 1, 2""")
def shift_share_z(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    share = P.shares(f.where("t <= 1996"), "c", "k", "q")
    shift = P.growth(f.groupBy("k", "t").agg(F.sum("q").alias("q")), "k", "t", "q")
    z = P.shift_share(share, shift, "c", "k", "t", ["g_level", "g_asinh"])
    return z.select("c", "t", F.round("z_g_level", 4).alias("z_level"), F.round("z_g_asinh", 6).alias("z_asinh"), "active")


@register("growth_variants", f"""WITH {_FLOWS}, g AS (SELECT k, t, q - lag(q) OVER w AS g, first_value(q) OVER w AS f FROM bt WINDOW w AS (PARTITION BY k ORDER BY t))
SELECT k, t, round(g, 4) AS g_level, round(g - avg(g) OVER (PARTITION BY t), 4) AS g_demeaned, round(g / nullif(f, 0), 6) AS g_base FROM g""")
def growth_variants(spark: SparkSession, d: str) -> DataFrame:
    g = P.growth(brand_years(spark, d), "k", "t", "q")
    return g.select("k", "t", F.round("g_level", 4).alias("g_level"), F.round("g_demeaned", 4).alias("g_demeaned"), F.round("g_base", 6).alias("g_base"))


@register("leave_one_out_z", f"""WITH {_FLOWS}, b AS (SELECT c, k, sum(q) AS x FROM fl WHERE t <= 1996 GROUP BY 1, 2),
s AS (SELECT c, k, x / sum(x) OVER (PARTITION BY c) AS share FROM b),
g AS (SELECT k, t, q - lag(q) OVER (PARTITION BY k ORDER BY t) AS g FROM bt),
p AS (SELECT k, c, t, share * g AS p FROM s JOIN g USING (k))
SELECT k, c, t, round(sum(p) OVER (PARTITION BY c, t) - coalesce(p, 0), 3) AS z FROM p""")
def leave_one_out_z(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d)
    share = P.shares(f.where("t <= 1996"), "c", "k", "q")
    shift = P.growth(f.groupBy("k", "t").agg(F.sum("q").alias("q")), "k", "t", "q").select("k", "t", "g_level")
    z = P.leave_one_out(share, shift, "c", "k", "t", "g_level")
    return z.select("k", "c", "t", F.round("z", 3).alias("z"))


_SPELLS = "sp AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, max(l_shipdate) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


def spells(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    last = l.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("b"))
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("a"), "b")


@register("interval_year_expand", f"WITH {_SPELLS} SELECT o_orderkey, CAST(unnest(range(greatest(year(a), 1992), least(year(b), 2001) + 1)) AS INTEGER) AS year FROM sp")
def interval_year_expand(spark: SparkSession, d: str) -> DataFrame:
    return P.spell_years(spells(spark, d), F.col("a"), F.col("b"), 1992, 2001).select("o_orderkey", "year")


@register("year_fraction", f"""WITH {_SPELLS}, y AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM sp)
SELECT o_orderkey, CAST(y AS INTEGER) AS year, round(greatest(0, least(CAST(b AS DATE), make_date(y, 12, 31)) - greatest(CAST(a AS DATE), make_date(y, 1, 1)) + 1)
/ (make_date(y, 12, 31) - make_date(y, 1, 1) + 1), 6) AS share FROM y""")
def year_fraction(spark: SparkSession, d: str) -> DataFrame:
    from loomspan.functions.values import year_share

    y = P.spell_years(spells(spark, d), F.col("a"), F.col("b"), 1900, 2100)
    return y.select("o_orderkey", "year", F.round(year_share(F.to_date("a"), F.to_date("b"), F.col("year")), 6).alias("share"))


@register("interval_overlap_join", f"""WITH {_SPELLS}, s AS (SELECT o_orderkey, o_custkey, year(a) AS x, CASE WHEN o_orderkey % 5 > 0 THEN year(b) END AS y FROM sp)
SELECT l.o_orderkey AS l_order, r.o_orderkey AS r_order FROM s l JOIN s r ON l.o_custkey = r.o_custkey AND l.x <= coalesce(r.y, 2001) + 1 AND coalesce(l.y, 2001) >= r.x - 1""")
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    s = spells(spark, d).select("o_orderkey", "o_custkey", F.year("a").alias("x"), F.when(F.col("o_orderkey") % 5 > 0, F.year("b")).alias("y"))
    left = s.withColumnRenamed("o_orderkey", "l_order")
    right = s.select(F.col("o_orderkey").alias("r_order"), "o_custkey", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return P.overlap_join(left, right, "o_custkey", ("x", "y"), ("rx", "ry"), 1, 2001).select("l_order", "r_order")


@register("snapshot_headcount", f"""WITH {_SPELLS} SELECT c_nationkey, CAST(y AS INTEGER) AS year, count(DISTINCT o_custkey) AS heads FROM sp JOIN customer ON c_custkey = o_custkey
JOIN (SELECT unnest(range(1992, 2002)) AS y) ON a <= make_date(y, 1, 1) AND b >= make_date(y, 1, 1) GROUP BY 1, 2""")
def snapshot_headcount(spark: SparkSession, d: str) -> DataFrame:
    y = P.spell_years(spells(spark, d), F.col("a"), F.col("b"), 1992, 2001)
    day = F.make_date("year", F.lit(1), F.lit(1)).cast("timestamp")
    y = y.where((F.col("a") <= day) & (F.col("b") >= day)).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return y.groupBy("c_nationkey", "year").agg(F.count_distinct("o_custkey").alias("heads"))


_SPARSE = "pt AS (SELECT p_partkey % 200 AS k, CAST(year(l_shipdate) AS INTEGER) AS t, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 GROUP BY 1, 2)"


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_quantity > 45")  # noqa: E741
    return l.groupBy((F.col("l_partkey") % 200).alias("k"), F.year("l_shipdate").alias("t")).agg(F.count("*").alias("n"))


@register("densify_zero_fill", f"WITH {_SPARSE}, b AS (SELECT k, unnest(range(min(t), max(t) + 1)) AS t FROM pt GROUP BY k) SELECT b.k, CAST(b.t AS INTEGER) AS t, coalesce(n, 0) AS n FROM b LEFT JOIN pt ON pt.k = b.k AND pt.t = b.t")
def densify_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return P.densify(_sparse(spark, d), ["k"], "t", ["n"])


@register("densify_grid", f"WITH {_SPARSE}, b AS (SELECT k, unnest(range(1990, 2004)) AS t FROM (SELECT DISTINCT k FROM pt)) SELECT b.k, CAST(b.t AS INTEGER) AS t, coalesce(n, 0) AS n FROM b LEFT JOIN pt ON pt.k = b.k AND pt.t = b.t")
def densify_grid(spark: SparkSession, d: str) -> DataFrame:
    return P.grid(_sparse(spark, d), ["k"], "t", 1990, 2003, ["n"])


@register("rolling_share_5y", f"""WITH {_FLOWS} SELECT c, k, t, round(sum(q) OVER (PARTITION BY c, k ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / sum(q) OVER (PARTITION BY c, k), 6) AS share FROM fl""")
def rolling_share_5y(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c", "k")
    run = F.sum("q").over(w.orderBy("t").rowsBetween(-4, 0))
    return flows(spark, d).select("c", "k", "t", F.round(run / F.sum("q").over(w), 6).alias("share"))


@register("pre_post_frames", f"""WITH {_FLOWS} SELECT k, t, round(avg(q) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS pre, round(avg(q) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 4) AS post,
round(avg(q) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 4) AS ahead FROM bt WINDOW w AS (PARTITION BY k ORDER BY t)""")
def pre_post_frames(spark: SparkSession, d: str) -> DataFrame:
    m = lambda a, b: F.round(P.frame_mean(["k"], "t", "q", a, b), 4)
    return brand_years(spark, d).select("k", "t", m(-3, -1).alias("pre"), m(1, 3).alias("post"), m(0, 4).alias("ahead"))


@register("gaps_islands", """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM g""")
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    gap = F.col("ts") > F.col("_before") + F.expr("INTERVAL 1 DAY")
    return P.islands(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], gap).select("event_id", "user_id", "island")


@register("event_detect_jump", f"""WITH {_FLOWS}, x AS (SELECT c, t, q - lag(q) OVER (PARTITION BY c ORDER BY t) AS d FROM nt), h AS (SELECT * FROM x WHERE d > 0 AND d >= (SELECT greatest(quantile_cont(d, 0.5), 10) FROM x WHERE d > 0))
SELECT c, arg_max(t, (d, -t)) AS event_time, round(max(d), 4) AS jump FROM h GROUP BY 1""")
def event_detect_jump(spark: SparkSession, d: str) -> DataFrame:
    j = P.largest_jump(nation_years(spark, d), "c", "t", "q", 10.0, 0.5)
    return j.select("c", "event_time", F.round("jump", 4).alias("jump"))


@register("school_event_break", f"""WITH {_FLOWS}, x AS (SELECT k, t, avg(q) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) - avg(q) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS s,
count(q) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) + count(q) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS n FROM bt WINDOW w AS (PARTITION BY k ORDER BY t))
SELECT k, arg_max(t, (round(s, 9), -t)) AS event_time, round(max(s), 4) AS score FROM x WHERE n = 4 GROUP BY 1""")
def school_event_break(spark: SparkSession, d: str) -> DataFrame:
    b = P.mean_break(brand_years(spark, d), "k", "t", "q", 2, 2)
    return b.select("k", "event_time", F.round("score", 4).alias("score"))


@register("relabel_detect", f"""WITH {_FLOWS}, x AS (SELECT c, k, t, lag(q) OVER w AS was, q - lag(q) OVER w AS d FROM fl WINDOW w AS (PARTITION BY c, k ORDER BY t)),
b AS (SELECT f.c, f.t, f.k AS source, r.k AS target, least(r.d / -f.d, -f.d / r.d) AS s FROM x f JOIN x r ON f.c = r.c AND f.t = r.t AND f.d < -0.3 * f.was AND r.d > 0.3 * r.was),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY c, t, source ORDER BY round(s, 9) DESC, target) = 1)
SELECT c, t, source, target, round(s, 6) AS offset_share FROM o QUALIFY row_number() OVER (PARTITION BY c, t ORDER BY round(s, 9) DESC, source) = 1""")
def relabel_detect(spark: SparkSession, d: str) -> DataFrame:
    r = P.relabels(flows(spark, d), "c", "k", "t", "q", 0.3, 0.3)
    return r.select("c", "t", "source", "target", F.round("offset_share", 6).alias("offset_share"))


_EVENTS = f"{_FLOWS}, ev AS (SELECT c, CAST(1994 + c % 4 AS INTEGER) AS event_time FROM (SELECT DISTINCT c FROM nt) WHERE c % 3 > 0)"


def nation_events(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c")).distinct()
    return n.where("c % 3 > 0").select("c", (1994 + F.col("c") % 4).cast("int").alias("event_time"))


@register("stacked_event_panel", f"""WITH {_EVENTS}, s AS (SELECT DISTINCT event_time AS stack FROM ev JOIN nt USING (c))
SELECT stack, nt.c, t, t - stack AS rel, CASE WHEN event_time = stack THEN 1 ELSE 0 END AS treated FROM nt LEFT JOIN ev ON ev.c = nt.c JOIN s ON t - stack BETWEEN -2 AND 2
WHERE event_time = stack OR event_time IS NULL OR event_time > stack + 2""")
def stacked_event_panel(spark: SparkSession, d: str) -> DataFrame:
    n = nation_years(spark, d)
    e = nation_events(spark, d).join(n.select("c").distinct(), "c", "left_semi")
    return P.stack(n, e, "c", "t", -2, 2).select("stack", "c", "t", "rel", "treated")


@register("event_time_means", f"WITH {_EVENTS} SELECT t - event_time AS rel, count(*) AS n, round(avg(q), 4) AS mean FROM nt JOIN ev USING (c) WHERE t - event_time BETWEEN -3 AND 3 GROUP BY 1")
def event_time_means(spark: SparkSession, d: str) -> DataFrame:
    p = P.event_panel(nation_years(spark, d), nation_events(spark, d), "c", "t", -3, 3)
    return p.groupBy("rel").agg(F.count("*").alias("n"), F.round(F.avg("q"), 4).alias("mean"))


@register("absorbing_flag", f"WITH {_FLOWS} SELECT c, t, max(CASE WHEN q > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t) AS treated FROM nt")
def absorbing_flag(spark: SparkSession, d: str) -> DataFrame:
    return P.absorbing(nation_years(spark, d), "c", "t", F.col("q") > 400).select("c", "t", "treated")


@register("outcome_lags_wide", f"""WITH {_FLOWS}, g AS (SELECT DISTINCT c, t - k AS t FROM nt, (SELECT unnest([-1, 0, 2]) AS k))
SELECT g.c, CAST(g.t AS INTEGER) AS t, round(a.q, 2) AS q_m1, round(b.q, 2) AS q_p0, round(e.q, 2) AS q_p2 FROM g
LEFT JOIN nt a ON a.c = g.c AND a.t = g.t - 1 LEFT JOIN nt b ON b.c = g.c AND b.t = g.t LEFT JOIN nt e ON e.c = g.c AND e.t = g.t + 2""")
def outcome_lags_wide(spark: SparkSession, d: str) -> DataFrame:
    w = P.lags_wide(nation_years(spark, d), "c", "t", "q", [-1, 0, 2])
    return w.select("c", "t", *[F.round(x, 2).alias(x) for x in ("q_m1", "q_p0", "q_p2")])


@register("balanced_panel", f"WITH {_FLOWS} SELECT c, k, t FROM fl WHERE (c, k) IN (SELECT (c, k) FROM fl GROUP BY c, k HAVING count(DISTINCT t) = 7)")
def balanced_panel(spark: SparkSession, d: str) -> DataFrame:
    f = flows(spark, d).withColumn("u", F.struct("c", "k"))
    return P.balanced(f, "u", "t", 7).select("c", "k", "t")


@register("quantile_bins", """WITH q AS (SELECT c_nationkey AS g, quantile_cont(c_acctbal, 0.25) AS a, median(c_acctbal) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer GROUP BY 1)
SELECT c_custkey, 1 + CAST(c_acctbal > a AS INTEGER) + CAST(c_acctbal > b AS INTEGER) + CAST(c_acctbal > c AS INTEGER) AS bin FROM customer JOIN q ON g = c_nationkey""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    return P.quantile_bins(table(spark, d, "customer"), "c_acctbal", 4, "bin", ["c_nationkey"]).select("c_custkey", "bin")


@register("binscatter", """WITH q AS (SELECT unnest(quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8])) AS cut FROM part),
b AS (SELECT p_partkey, p_size, p_retailprice, CAST(1 + (SELECT count(*) FROM q WHERE p_retailprice > cut) AS INTEGER) AS bin FROM part)
SELECT bin, count(*) AS n, round(avg(p_retailprice), 4) AS x, round(avg(p_size), 4) AS y FROM b GROUP BY 1""")
def binscatter(spark: SparkSession, d: str) -> DataFrame:
    b = P.quantile_bins(table(spark, d, "part"), "p_retailprice", 5, "bin")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("x"), F.round(F.avg("p_size"), 4).alias("y"))


@register("slope_by_group", f"WITH {_FLOWS} SELECT k, round(CASE WHEN count(*) >= 3 THEN regr_slope(q, t) END, 6) AS slope, round(avg(q), 4) AS level, round(count(*) / 5.0, 6) AS coverage FROM bt WHERE t BETWEEN 1995 AND 1999 GROUP BY 1")
def slope_by_group(spark: SparkSession, d: str) -> DataFrame:
    p = P.pre_period(brand_years(spark, d), "k", "t", "q", 1995, 1999)
    return p.select("k", F.round("slope", 6).alias("slope"), F.round("level", 4).alias("level"), F.round("coverage", 6).alias("coverage"))
