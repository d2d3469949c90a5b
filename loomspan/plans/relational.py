"""Joins, aggregates, windows, order, samples and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import values
from loomspan.operators import relational as R
from loomspan.plans.registry import register, table


def _keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers with a nullable nation, and nations with a nullable region."""
    c = table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("nk"), "c_acctbal")
    n = table(spark, d, "nation").select(F.nullif("n_nationkey", F.lit(3)).alias("nk"), "n_name", "n_regionkey")
    return c, n


_KEYED = """c AS (SELECT c_custkey, nullif(c_nationkey, 7) AS nk, c_acctbal FROM customer),
n AS (SELECT nullif(n_nationkey, 3) AS nk, n_name, n_regionkey FROM nation)"""


def _join_query(how: str, sql: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c, n = _keyed(spark, d)
        n = n.withColumnRenamed("nk", "n_nk")
        on = F.col("nk") == F.col("n_nk")
        if how in ("left_semi", "left_anti"):
            return c.join(n, on, how).select("c_custkey", "nk")
        return c.join(n, on, how).select("c_custkey", "nk", F.col("n_nk"), "n_name")

    register(f"join_{how.removeprefix('left_') if how != 'left' else how}", f"WITH {_KEYED} {sql}")(query)


for _how, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    _join_query(_how, f"SELECT c_custkey, c.nk, n.nk AS n_nk, n_name FROM c {_word} n ON c.nk = n.nk")
_join_query("left_semi", "SELECT c_custkey, nk FROM c WHERE nk IN (SELECT nk FROM n WHERE nk IS NOT NULL)")
_join_query("left_anti", "SELECT c_custkey, c.nk FROM c LEFT JOIN n ON c.nk = n.nk WHERE n.n_name IS NULL")


@register("join_not_in", """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, nullif(o_custkey, 10) AS o_custkey FROM orders)
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def join_not_in(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(10)).alias("o_custkey"))
    return R.not_in(o, "o_custkey", table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")


@register("join_exists", """SELECT c_custkey, c_name FROM customer c WHERE EXISTS (
SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 20 * c.c_acctbal + 100000)""")
def join_exists(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, (o.o_custkey == c.c_custkey) & (o.o_totalprice > 20 * c.c_acctbal + 100000), "left_semi").select("c_custkey", "c_name")


@register("join_cross_grid", """SELECT n_nationkey, y.y AS year, count(o_orderkey) AS n FROM nation
CROSS JOIN (SELECT unnest(range(1992, 2002)) AS y) y
LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = y.y GROUP BY 1, 2""")
def join_cross_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1992), F.lit(2001))).alias("year"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.groupBy("c_nationkey", F.year("o_orderdate").alias("_y")).agg(F.count("*").alias("n"))
    both = grid.join(n, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("year") == F.col("_y")), "left")
    return both.select("n_nationkey", F.col("year").cast("long").alias("year"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("join_theta", """SELECT c_custkey, s_suppkey FROM customer JOIN supplier
ON c_nationkey = s_nationkey AND (abs(c_acctbal - s_acctbal) <= 500 OR s_acctbal IS NULL)""")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    near = (F.abs(c.c_acctbal - s.s_acctbal) <= 500) | s.s_acctbal.isNull()
    return c.join(s, (c.c_nationkey == s.s_nationkey) & near).select("c_custkey", "s_suppkey")


@register("evidence_rank_crosswalk", """WITH e AS (
SELECT c_custkey, s_suppkey, CASE WHEN c_mktsegment LIKE 'B%' AND c_custkey % 7 = s_suppkey % 7 THEN 3
  WHEN c_custkey % 5 = s_suppkey % 5 THEN 2 ELSE 1 END AS evidence
FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT * FROM e QUALIFY evidence = max(evidence) OVER (PARTITION BY c_custkey)""")
def evidence_rank_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_nationkey") == F.col("s_nationkey"))
    strong = F.col("c_mktsegment").startswith("B") & (F.col("c_custkey") % 7 == F.col("s_suppkey") % 7)
    rank = F.when(strong, 3).when(F.col("c_custkey") % 5 == F.col("s_suppkey") % 5, 2).otherwise(1)
    e = e.select("c_custkey", "s_suppkey", rank.alias("evidence"))
    return e.withColumn("m", F.max("evidence").over(Window.partitionBy("c_custkey"))).where("evidence = m").drop("m")


@register("rare_pair_swap_join", """WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 50 AS b FROM part)
SELECT x.p_partkey AS left_key, y.p_partkey AS right_key FROM p x JOIN p y
ON x.p_partkey < y.p_partkey AND ((x.a = y.a AND x.b = y.b) OR (x.a = y.b AND x.b = y.a))""")
def rare_pair_swap_join(spark: SparkSession, d: str) -> DataFrame:
    """An OR of two equi-conditions as one on the ordered pair."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 50).alias("b"))
    p = p.select("p_partkey", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    q = p.select(F.col("p_partkey").alias("q"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    on = (F.col("lo") == F.col("q_lo")) & (F.col("hi") == F.col("q_hi")) & (F.col("p_partkey") < F.col("q"))
    return p.join(q, on).select(F.col("p_partkey").alias("left_key"), F.col("q").alias("right_key"))


@register("next_row_impute", """SELECT o_orderkey, CAST(CAST(min(b) AS DATE) AS VARCHAR) AS next_date FROM (
SELECT a.o_orderkey, b.o_orderdate AS b, b.o_orderkey AS k FROM orders a LEFT JOIN orders b
ON a.o_custkey = b.o_custkey AND b.o_orderdate >= a.o_orderdate + INTERVAL 6 MONTH) GROUP BY 1""")
def next_row_impute(spark: SparkSession, d: str) -> DataFrame:
    """The customer's next order at least six months on."""
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    b = a.select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("b"))
    on = (F.col("o_custkey") == F.col("c")) & (F.col("b") >= F.col("o_orderdate") + F.expr("INTERVAL 6 MONTHS"))
    return a.join(b, on, "left").groupBy("o_orderkey").agg(F.to_date(F.min("b")).cast("string").alias("next_date"))


@register("latest_before", """SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, value FROM events) e
JOIN orders o ON o.o_custkey = e.user_id AND o.o_totalprice < 1000 * e.value
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) = 1""")
def latest_before(spark: SparkSession, d: str) -> DataFrame:
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    both = e.join(o, (o.o_custkey == e.user_id) & (o.o_totalprice < 1000 * e.value))
    return R.first_per(both, ["event_id"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("event_id", "o_orderkey")


@register("event_isolation", """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE value > 50)
SELECT event_id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_id <> a.event_id
AND b.ts BETWEEN a.ts - INTERVAL 2 DAY AND a.ts + INTERVAL 2 DAY)""")
def event_isolation(spark: SparkSession, d: str) -> DataFrame:
    """No other qualified event of the user within two days: its neighbours tell."""
    e = table(spark, d, "events").where("value > 50").select("event_id", "user_id", "ts")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.expr("INTERVAL 2 DAYS")
    e = e.withColumn("b", F.lag("ts").over(order)).withColumn("a", F.lead("ts").over(order))
    alone = (F.col("b").isNull() | (F.col("b") < F.col("ts") - near)) & (F.col("a").isNull() | (F.col("a") > F.col("ts") + near))
    return e.where(alone).select("event_id")


@register("agg_basic", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
round(avg(l_discount), 6) AS avg_disc, round(var_samp(l_quantity), 4) AS var_qty, round(stddev_samp(l_tax), 6) AS sd_tax
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.round(F.var_samp("l_quantity"), 4).alias("var_qty"), F.round(F.stddev_samp("l_tax"), 6).alias("sd_tax"),
    ).where("n > 1")


@register("filter_agg", """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS n_r,
round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS big,
count(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey END) AS n_parts FROM lineitem GROUP BY 1""")
def filter_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2).alias("big"),
        F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("n_parts"),
    )


@register("count_distinct_over", """SELECT o_orderkey, o_custkey, n FROM orders
JOIN (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) ON o_custkey = k""")
def count_distinct_over(spark: SparkSession, d: str) -> DataFrame:
    n = R.distinct_over(F.col("o_orderpriority"), ["o_custkey"])
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", n.cast("long").alias("n"))


@register("percentiles", """SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.25), 4) AS p25, round(median(c_acctbal), 4) AS p50,
round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("c_acctbal", q), 4)
    return table(spark, d, "customer").groupBy("c_nationkey").agg(p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.9).alias("p90"))


@register("argmax_argmin", """SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest,
arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY 1""")
def argmax_argmin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"),
        F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"),
    )


@register("ordered_list", """SELECT l_orderkey, to_json(list(l_partkey ORDER BY l_linenumber, l_partkey)) AS parts,
arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS top_part FROM lineitem GROUP BY 1""")
def ordered_list(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.transform(rows, lambda r: r["l_partkey"])).alias("parts"),
        F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).alias("top_part"),
    )


@register("string_agg", """SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def string_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("names"))


@register("modal_value", """SELECT o_custkey, o_orderpriority, n FROM (
SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def modal_value(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return R.first_per(n, ["o_custkey"], [F.col("n").desc(), F.col("o_orderpriority").asc()])


@register("weighted_mean", """SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / nullif(sum(l_quantity), 0), 4) AS mean,
round(sum(l_quantity) ^ 2 / sum(l_quantity ^ 2), 2) AS effective_n FROM lineitem GROUP BY 1""")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    w, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(values.ratio(F.sum(w * y), F.sum(w)), 4).alias("mean"), F.round(F.pow(F.sum(w), 2) / F.sum(w * w), 2).alias("effective_n")
    )


@register("share_of_total", """SELECT s_nationkey, s_suppkey, round(s_acctbal / nullif(sum(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 6) AS share FROM supplier""")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum("s_acctbal").over(Window.partitionBy("s_nationkey"))
    return table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.round(values.ratio(F.col("s_acctbal"), total), 6).alias("share"))


@register("distinct_on_latest", """SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC""")
def distinct_on_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    o = R.first_per(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return o.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@register("topk_per_group", """SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey,
CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_size, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 3""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("p_retailprice").desc_nulls_last(), F.col("p_size").asc_nulls_last(), F.col("p_partkey").asc()]
    return R.top_per(table(spark, d, "part"), ["p_brand"], order, 3, "rank").select("p_brand", "p_partkey", "rank")


@register("rank_family", """SELECT c_custkey, CAST(dense_rank() OVER w AS INTEGER) AS dense, round(100 * percent_rank() OVER w, 6) AS pct,
first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS richest
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""")
def rank_family(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    rich = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey", F.dense_rank().over(w).alias("dense"), F.round(100 * F.percent_rank().over(w), 6).alias("pct"), F.first("c_custkey").over(rich).alias("richest")
    )


@register("lag_lead", """SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after,
round(value - lag(value) OVER w, 6) AS diff FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_lead(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("value").over(w)
    return table(spark, d, "events").select("event_id", before.alias("before"), F.lead("value").over(w).alias("after"), F.round(F.col("value") - before, 6).alias("diff"))


@register("keep_near_max", """SELECT o_custkey, o_orderkey FROM orders QUALIFY o_totalprice >= max(o_totalprice) OVER (PARTITION BY o_custkey) - 20000""")
def keep_near_max(spark: SparkSession, d: str) -> DataFrame:
    top = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").withColumn("_top", top).where(F.col("o_totalprice") >= F.col("_top") - 20000).select("o_custkey", "o_orderkey")


@register("nulls_order", """SELECT c_custkey, CAST(row_number() OVER (ORDER BY nk DESC NULLS LAST, c_custkey) AS INTEGER) AS place
FROM (SELECT c_custkey, nullif(c_nationkey, 7) AS nk FROM customer) ORDER BY nk DESC NULLS LAST, c_custkey LIMIT 50""")
def nulls_order(spark: SparkSession, d: str) -> DataFrame:
    c = _keyed(spark, d)[0].orderBy(F.col("nk").desc_nulls_last(), "c_custkey").limit(50)
    w = Window.orderBy(F.col("nk").desc_nulls_last(), "c_custkey")  # over the 50 rows of the report
    return c.select("c_custkey", F.row_number().over(w).alias("place"))


@register("hash_sample")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 42)


@register("cluster_sample")
def cluster_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.cluster_sample(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 0.2, 1)


@register("hold_out_split")
def hold_out_split(spark: SparkSession, d: str) -> DataFrame:
    return R.hold_out(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"], 0.2, 3)


@register("shard_equivalence", "SELECT abs(o_custkey) % 4 AS shard, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def shard_equivalence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(R.shard(F.col("o_custkey"), 4).alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("set_union", """SELECT nk FROM (SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1""")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nk"))
    both = a.union(table(spark, d, "supplier").select("s_nationkey")).distinct()
    return both.unionByName(table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nk")))


@register("set_except_intersect", """(SELECT c_nationkey AS nk, 'only' AS what FROM customer EXCEPT SELECT s_nationkey, 'only' FROM supplier)
UNION ALL (SELECT c_nationkey, 'both' FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)""")
def set_except_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nk")), table(spark, d, "supplier").select("s_nationkey")
    return a.subtract(b).withColumn("what", F.lit("only")).unionByName(a.intersect(b).withColumn("what", F.lit("both")))


@register("snapshot_join_leave", """WITH s AS (SELECT DISTINCT user_id AS member, day(ts) AS snapshot FROM events),
g AS (SELECT min(snapshot) AS a, max(snapshot) AS b FROM s)
SELECT member, snapshot, 'join' AS event FROM s, g WHERE snapshot > a AND NOT EXISTS (SELECT 1 FROM s p WHERE p.member = s.member AND p.snapshot = s.snapshot - 1)
UNION ALL SELECT member, snapshot + 1, 'leave' FROM s, g WHERE snapshot < b AND NOT EXISTS (SELECT 1 FROM s p WHERE p.member = s.member AND p.snapshot = s.snapshot + 1)""")
def snapshot_join_leave(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").cast("long").alias("day"))
    return R.join_leave(e, "user_id", "day")


_YEARS = tuple(range(1992, 2002))


@register("cond_pivot", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE year(o_orderdate) = {y}) AS y{y}" for y in _YEARS) + " FROM orders GROUP BY 1")
def cond_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return o.groupBy("o_orderpriority").agg(*[F.count_if(F.col("y") == y).alias(f"y{y}") for y in _YEARS])


@register("pivot_first", "SELECT o_custkey, " + ", ".join(f"round(max(CASE WHEN o_orderpriority LIKE '{k}%' THEN o_totalprice END), 2) AS p{k}" for k in (1, 2, 3)) + " FROM orders GROUP BY 1")
def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("p", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    return o.groupBy("o_custkey").pivot("p", ["p1", "p2", "p3"]).agg(F.round(F.max("o_totalprice"), 2))


@register("unpivot_long", """SELECT l_orderkey, l_linenumber, name, value FROM (
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))""")
def unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@register("select_except", "SELECT * EXCLUDE (c_name, c_acctbal), c_acctbal IS NULL AS no_balance, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' ELSE 'high' END AS band FROM customer")
def select_except(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal").between(0, 1000), "low").otherwise("high")
    return c.select(*[x for x in c.columns if x not in ("c_name", "c_acctbal")], F.col("c_acctbal").isNull().alias("no_balance"), band.alias("band"))


@register("optional_columns", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS who, CAST(NULL AS VARCHAR) AS city FROM orders
UNION ALL SELECT event_id, NULL, NULL FROM events""")
def optional_columns(spark: SparkSession, d: str) -> DataFrame:
    schema = {"o_orderkey": "bigint", "who": "string", "city": "string"}
    o = table(spark, d, "orders")
    o = o.select("o_orderkey", R.optional(o, ["customer", "o_custkey"], "string").alias("who"))
    return R.append_aligned([o, table(spark, d, "events").select(F.col("event_id").alias("o_orderkey"))], schema)


@register("lenient_casts", """SELECT o_orderkey, CAST(round(TRY_CAST(t AS DOUBLE)) AS BIGINT) AS n,
year(o_orderdate) * 12 + month(o_orderdate) - 1992 * 12 - 1 AS months FROM (
SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '.5' ELSE CAST(o_orderkey AS VARCHAR) END AS t FROM orders)""")
def lenient_casts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    t = F.when(F.col("o_orderkey") % 3 == 0, "x").when(F.col("o_orderkey") % 3 == 1, F.concat(key, F.lit(".5"))).otherwise(key)
    start = F.lit("1992-01-01").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", values.lenient_int(t).alias("n"), values.months_crossed(start, F.col("o_orderdate")).cast("long").alias("months"))


@register("date_parse_multi", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM orders""")
def date_parse_multi(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in five ways, read back."""
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    ways = [F.date_format(day, f) for f in ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "dd-MMM-yyyy")]
    text = F.lit(None).cast("string")
    for k, way in enumerate([*ways, serial]):
        text = F.when(F.col("o_orderkey") % 5 == k, way).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", values.parse_date(text).cast("string").alias("parsed"))


@register("props_json", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@register("array_struct_candidates", """SELECT l_orderkey, to_json(list({'part': l_partkey, 'qty': CAST(l_quantity AS INTEGER)} ORDER BY l_linenumber, l_partkey, l_quantity)) AS items,
len(list(l_partkey) FILTER (WHERE l_quantity > 25)) AS n_big FROM lineitem GROUP BY 1""")
def array_struct_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    got = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("x"))
    item = F.transform("x", lambda r: F.struct(r["l_partkey"].alias("part"), r["l_quantity"].cast("int").alias("qty")))
    big = F.size(F.filter("x", lambda r: r["l_quantity"] > 25)).cast("long")
    return got.select("l_orderkey", F.to_json(item).alias("items"), F.when(big > 0, big).alias("n_big"))
