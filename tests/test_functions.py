from __future__ import annotations

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import similarity as S
from loomspan.functions import text as T
from loomspan.functions import values as V
from loomspan.operators import assignment as A
from loomspan.operators import estimators as E
from loomspan.operators import linkage as L
from loomspan.operators import panel as P
from loomspan.operators import relational as R
from loomspan.operators.graph import components


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_similarities():
    assert S.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert S.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro("", "") == 1.0 and S.jaro("a", "") == 0.0
    assert S.damerau_levenshtein("ca", "abc") == 2
    assert S.indel_ratio("new york", "york new") == pytest.approx(0.5)


def test_text(spark):
    t = F.col("t")
    assert one(spark, T.institution(t), t="Univ. of Köln (Main) & Co") == "univ of koln and co"
    assert one(spark, T.company(t), t="The Acme Co., Inc.") == "acme"
    assert one(spark, T.company_stem(t), t="Inc Labs Corp. LLC") == "inc labs"
    assert one(spark, T.full_name(t), t="Ann B. O'Neil (Annie), PhD") == "ann o'neil"
    assert one(spark, T.title_case(t), t="o'neil smith-jones") == "O'Neil Smith-Jones"
    assert one(spark, T.zip5(t), t="2139-4307") == "02139"
    assert one(spark, T.zip5(t), t=None) is None
    assert one(spark, F.size(T.ngrams(T.words(t), 3)), t="a b") == 0


def test_values(spark):
    t = F.col("t")
    assert one(spark, V.lenient_int(t), t="2.5") == 3
    assert one(spark, V.lenient_int(t), t="x") is None
    assert one(spark, V.parse_date(t), t="03-Feb-2015") == datetime.date(2015, 2, 3)
    assert one(spark, V.parse_date(t), t="42038") == datetime.date(2015, 2, 3)
    assert one(spark, V.parse_date(t), t="2815-01-01") is None
    assert one(spark, V.ratio(F.lit(1), F.lit(0)), t="") is None


def test_not_in_with_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    rows = lambda df: sorted(r.x for r in df.collect() if r.x is not None)
    assert rows(R.not_in(a, "x", spark.createDataFrame([(1,)], "y int"), "y")) == [2]
    assert R.not_in(a, "x", spark.createDataFrame([(1,), (None,)], "y int"), "y").count() == 0
    assert R.not_in(a, "x", spark.createDataFrame([], "y int"), "y").count() == 3


def test_check_unique(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="a key repeats"):
        R.check_unique(df, ["k"]).collect()


def test_align_types(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, old string"), spark.createDataFrame([("7", 2.5)], "k string, v double")
    out = R.append_aligned([a, b], {"k": "bigint", "v": "double"})
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (7, 2.5)]


def test_components_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)], "a long, b long")
    found = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert {found[i] for i in range(61)} == {0} and found[101] == 100 and 200 not in found


def test_solve_against_all_choices():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = rng.integers(1, 5, 2)
        gain = rng.integers(-2, 10, (n, m)).astype(float)
        best = 0.0
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    best = max(best, sum(max(gain[r, c], 0) for r, c in zip(rows, cols, strict=True)))
        assert sum(gain[i, j] for i, j in A.solve([{j: g for j, g in enumerate(r) if g > 0} for r in gain])) == pytest.approx(best)


def test_assignment_operators(spark):
    pairs = spark.createDataFrame([("g", 1, 1, 5.0), ("g", 1, 2, 4.0), ("g", 2, 1, 4.5), ("g", 2, 2, 0.0), ("h", 3, 9, 1.0)], "g string, a int, b int, s double")
    within = A.assign_within(pairs, ["g"], "a", "b", "s")
    assert sorted((r.a, r.b) for r in within.collect()) == [(1, 2), (2, 1), (3, 9)]
    assert sorted((r.a, r.b) for r in A.assign_globally(pairs.drop("g"), "a", "b", "s").collect()) == [(1, 2), (2, 1), (3, 9)]


def test_fixed_effects_against_dummies(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), float(rng.normal()), float(rng.normal())) for c in range(8) for t in range(5) if rng.random() > 0.15]
    df = spark.createDataFrame(rows, "c int, t int, y double, x double")
    fit = E.ols(df, "y", ["x"], ["c", "t"], "c")
    y, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    d = np.column_stack([x, *[[float(r[0] == c) for r in rows] for c in range(8)], *[[float(r[1] == t) for r in rows] for t in range(1, 5)]])
    assert fit.beta[0] == pytest.approx(np.linalg.lstsq(d, y, rcond=None)[0][0], abs=1e-7)


def test_ppml_first_order_condition(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), float(x := rng.normal()), float(rng.poisson(np.exp(0.3 * x + c / 5)))) for c in range(6) for _ in range(8)]
    df = spark.createDataFrame(rows, "c int, x double, y double")
    fit = E.ppml(df, "y", ["x"], "c", "c")
    c, x, y = (np.array(v) for v in zip(*rows, strict=True))
    e = np.exp(fit.beta[0] * x)
    mu = np.array([y[c == k].sum() * v / e[c == k].sum() for k, v in zip(c, e, strict=True)])
    assert abs(((y - mu) * x).sum()) < 1e-6


def test_iv_just_identified(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(10):
        for t in range(6):
            z = rng.normal()
            x = z + rng.normal()
            rows.append((c, t, float(2 * x + rng.normal()), float(x), float(z)))
    df = spark.createDataFrame(rows, "c int, t int, y double, x double, z double")
    fit, first = E.iv(df, "y", "x", "z", [], ["c"], "c")
    a = np.array(rows)
    dm = lambda v: v - np.array([v[a[:, 0] == k].mean() for k in a[:, 0]])
    assert fit.beta[0] == pytest.approx((dm(a[:, 4]) @ dm(a[:, 2])) / (dm(a[:, 4]) @ dm(a[:, 3])), abs=1e-8)
    assert first > 10


def test_panel_guards(spark):
    df = spark.createDataFrame([(1, "2003-01-01", "2001-01-01"), (2, "2000-05-01", None)], "k int, a string, b string")
    df = df.select("k", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    assert [(r.k, r.year) for r in P.spell_years(df, F.col("a"), F.col("b"), 1999, 2002).orderBy("year").collect()] == [(2, 2000), (2, 2001), (2, 2002)]


def test_prune_keeps_unscored(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 0.9), (2, 0.5)], "k int, s double")
    assert L.prune(df, ["k"], "s", 0.1).count() == 3


def test_lsh_three_tokens(spark):
    df = spark.createDataFrame([(["b", "a", "c", "d"],)], "t array<string>")
    assert sorted(df.select(L.lsh_bands(F.col("t"), 3)).first()[0]) == ["a b c", "a b d", "a c d", "b c d"]
