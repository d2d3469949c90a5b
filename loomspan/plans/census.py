"""Functions and frame calls that other queries don't use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import similarity as S
from loomspan.functions import text as T
from loomspan.functions import values as V
from loomspan.operators import ranges as G
from loomspan.operators import relational as R
from loomspan.plans.registry import register, table
from loomspan.plans.texts import _PAIRS, _by_texts


@register("string_functions", r"""SELECT c_custkey, array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
array_to_string(regexp_extract_all(t, '[0-9]'), '') AS digits, split_part(t, '#', 2) AS tail, regexp_replace(t, '0', '_') AS first_only
FROM (SELECT c_custkey, c_name || ' OF ' || c_mktsegment AS t FROM customer)""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("c_name", F.lit(" OF "), "c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.initcap(t).alias("title"), F.array_join(F.regexp_extract_all(t, F.lit("[0-9]"), 0), "").alias("digits"),
        F.split_part(t, F.lit("#"), F.lit(2)).alias("tail"), T.replace_first(t, "0", "_").alias("first_only"),
    )


@register("list_functions", """WITH l AS (SELECT o_custkey, list(CAST(o_orderkey % 7 + 1 AS DOUBLE) ORDER BY o_orderkey) AS a, list(o_orderstatus ORDER BY o_orderkey) AS b FROM orders GROUP BY 1)
SELECT o_custkey, list_contains(a, 3) AS has_three, list_product(a[1:6]) AS product, list_median(a) AS middle,
array_to_string(list_transform(list_zip(a, b), lambda z: CAST(CAST(z[1] AS INTEGER) AS VARCHAR) || z[2]), ',') AS zipped FROM l""")
def list_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("double").alias("a"), F.col("o_orderstatus").alias("b")))).alias("l"))
    o = o.select("o_custkey", F.col("l.a").alias("a"), F.col("l.b").alias("b"))
    zipped = F.transform(F.arrays_zip("a", "b"), lambda z: F.concat(z["a"].cast("int").cast("string"), z["b"]))
    return o.select("o_custkey", F.array_contains("a", 3.0).alias("has_three"), V.list_product(F.slice("a", 1, 6)).alias("product"), V.list_median(F.col("a")).alias("middle"), F.array_join(zipped, ",").alias("zipped"))


@register("number_functions", """SELECT o_custkey, any_value(o_custkey % 9) AS same, max(ceil(o_totalprice / 1000)) AS up, bool_and(random() BETWEEN 0 AND 1) AS within,
round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS std_error FROM orders GROUP BY 1""")
def number_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("r", F.rand()).groupBy("o_custkey").agg(
        F.any_value(F.col("o_custkey") % 9).alias("same"), F.max(F.ceil(F.col("o_totalprice") / 1000).cast("double")).alias("up"), F.bool_and(F.col("r").between(0, 1)).alias("within"),
        F.round(F.stddev_samp("o_totalprice") / F.sqrt(F.count("*")), 4).alias("std_error"),
    )


@register("date_age", """SELECT o_orderkey, CAST(date_part('year', age(TIMESTAMP '2002-03-05', o_orderdate::TIMESTAMP)) AS INTEGER) AS years,
CAST(date_part('month', age(TIMESTAMP '2002-03-05', o_orderdate::TIMESTAMP)) AS INTEGER) AS months FROM orders""")
def date_age(spark: SparkSession, d: str) -> DataFrame:
    months = F.floor(F.months_between(F.lit("2002-03-05").cast("timestamp"), F.col("o_orderdate").cast("timestamp")))
    return table(spark, d, "orders").select("o_orderkey", F.floor(months / 12).cast("int").alias("years"), (months % 12).cast("int").alias("months"))


@register("json_validity", """SELECT event_id, json_valid(t) AS valid FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN left(props, 4) WHEN 1 THEN 'k' ELSE props END AS t FROM events)""")
def json_validity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    t = F.when(k == 0, F.left("props", F.lit(4))).when(k == 1, "k").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_parse_json(t).isNotNull().alias("valid"))


@register("fill_gaps", """WITH v AS (SELECT event_id, user_id, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled,
first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back FROM v""")
def fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    v = R.fill(R.fill(v, ["user_id"], ["event_id"], "v", "filled"), ["user_id"], ["event_id"], "v", "back", forward=False)
    return v.select("event_id", "filled", "back")


@register("cut_bins", """SELECT c_custkey, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 0 WHEN c_acctbal > 0 AND c_acctbal <= 2500 THEN 1
WHEN c_acctbal > 2500 AND c_acctbal <= 10000 THEN 2 END AS bin FROM customer""")
def cut_bins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", V.cut(F.col("c_acctbal"), [-1000.0, 0.0, 2500.0, 10000.0]).alias("bin"))


@register("dummy_columns", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER) AS status_{s}" for s in "FOP") + " FROM orders")
def dummy_columns(spark: SparkSession, d: str) -> DataFrame:
    return R.dummies(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], "status")


@register("crosstab_counts", "SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in ("BUILDING", "MACHINERY", "HOUSEHOLD")) + ", count(*) AS whole FROM customer GROUP BY 1")
def crosstab_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("BUILDING", "MACHINERY", "HOUSEHOLD")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(*[F.count_if(F.col("c_mktsegment") == s).alias(s.lower()) for s in names], F.count("*").alias("whole"))


@register("duplicated_rows", """SELECT c_custkey, count(*) OVER w > 1 AS dup_any, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1 AS dup_later
FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)""")
def duplicated_rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey", "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", (F.count("*").over(w) > 1).alias("dup_any"), (F.row_number().over(w.orderBy("c_custkey")) > 1).alias("dup_later"))


@register("global_row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def global_row_id(spark: SparkSession, d: str) -> DataFrame:
    """Numbers over all rows, dealt by ranges: no task sees the whole table."""
    return G.row_ids(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "id").select("o_orderkey", "id")


@register("auc_brier", """WITH s AS (SELECT round((c_acctbal + 1000) / 11000, 2) AS s, CASE WHEN c_mktsegment < 'F' THEN 1 ELSE 0 END AS y FROM customer),
r AS (SELECT s, y, avg(n) OVER (PARTITION BY s) AS rank FROM (SELECT s, y, row_number() OVER (ORDER BY s) AS n FROM s))
SELECT count(*) AS n, round((sum(y * rank) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg((s - y) ** 2), 6) AS brier FROM r""")
def auc_brier(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.round((F.col("c_acctbal") + 1000) / 11000, 2).alias("s"), (F.col("c_mktsegment") < "F").cast("int").alias("y"))
    return G.auc_and_brier(c, "s", "y").select("n", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))


@register("sample_rows", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM (SELECT o_orderkey FROM orders USING SAMPLE reservoir(100 ROWS) REPEATABLE (7))")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Exactly so many rows, in hash order: the same ones at each run."""
    return R.hash_sample(table(spark, d, "orders"), "o_orderkey", 100, 7).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@register("token_ratios")
def token_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of words as sets, of the best part, and their weighted best."""
    a, b = F.col("a"), F.col("b")
    return _by_texts(spark, d, lambda p: p.select("pair", *[F.round(f(a, b), 4).alias(n) for n, f in (("plain", S.plain_ratio), ("token_set", S.token_set_ratio), ("partial", S.partial_ratio), ("weighted", S.weighted_ratio))]))


@register("osa_rules")
def osa_rules(spark: SparkSession, d: str) -> DataFrame:
    """Edits of each pair, neighbours swapped as one, none edited twice. All
    pairs have a row, whatever the edits and however often a text stands in the
    table: a rule such as two edits at most is read from the column."""
    return _by_texts(spark, d, lambda p: p.select("pair", S.osa_distance("a", "b").alias("osa")))


@register("lev_within_bound", f"WITH {_PAIRS} SELECT a_key, b_key FROM p WHERE levenshtein(a, b) <= 12")
def lev_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """A distance with a bound: the JVM stops counting beyond it."""
    return _by_texts(spark, d, lambda p: p.where(F.levenshtein("a", "b", 12) >= 0).select("pair"))
