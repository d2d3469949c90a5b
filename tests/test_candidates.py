"""Operators without SQL, and odd rows, against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import similarity as S
from loomspan.operators import assignment as A
from loomspan.operators import candidates as C
from loomspan.operators import neighbours, ranges
from loomspan.operators import relational as R
from loomspan.plans import catalogue


def best_choice(left, right, caliper):
    """The most pairs and then the least distance, by trying all."""
    best = (0, 0.0)
    k = min(len(left), len(right))
    for n in range(1, k + 1):
        for a in itertools.combinations(left, n):
            for b in itertools.permutations(right, n):
                gaps = [abs(x[1] - y[1]) for x, y in zip(a, b, strict=True)]
                if all(g <= caliper for g in gaps):
                    best = max(best, (n, -sum(gaps)))
    return best


def test_optimal_match_against_all_choices(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(100 * c + k), bool(k < 4), float(rng.integers(0, 12))) for c in range(6) for k in range(8)] + [(0, 900, True, None), (0, 901, False, float("nan")), (9, 902, True, 1.0)]
    df = spark.createDataFrame(rows, "cell long, k long, t boolean, v double")
    found = A.optimal_within(df.where("t"), df.where("NOT t"), ["cell"], "k", "v", 2.0).collect()
    for cell in range(6):
        mine = [r for r in found if r.cell == cell]
        side = lambda t, c=cell: [(k, v) for x, k, s, v in rows if x == c and s == t and v is not None and v == v]
        assert (len(mine), -sum(r.distance for r in mine)) == pytest.approx(best_choice(side(True), side(False), 2.0))
        assert len({r.k for r in mine}) == len({r.match for r in mine}) == len(mine)
    assert not [r for r in found if r.cell == 9]
    assert A.optimal_within(df.limit(0), df.limit(0), ["cell"], "k", "v", 2.0).count() == 0


def test_global_assignment_takes_the_best_total(spark):
    pairs = [(1, 1, 5.0), (1, 2, 4.0), (2, 1, 4.5), (2, 2, 1.0), (3, 3, 2.0), (4, 3, 3.0), (4, 3, 1.0), (5, 9, 0.0)]
    out = A.assign_globally(spark.createDataFrame(pairs, "l long, r long, s double"), "l", "r", "s").collect()
    assert {(r.l, r.r) for r in out} == {(1, 2), (2, 1), (4, 3)}


def test_running_total_and_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(["a", "b", None][int(k)], int(x), int(v)) for k, x, v in zip(rng.integers(0, 3, 200), rng.permutation(200), rng.integers(0, 9, 200), strict=True)]
    df = spark.createDataFrame(rows, "g string, x long, v long")
    for r in ranges.running_total(df, ["x"], F.col("v"), "before", ["g"]).collect():
        assert r.before == sum(v for g, x, v in rows if x < r.x and g == r.g)
    assert sorted((r.x, r.id) for r in ranges.row_ids(df, ["x"], "id").collect()) == [(i, i + 1) for i in range(200)]
    assert ranges.row_ids(df.limit(0), ["x"], "id").count() == 0


def test_auc_counts_ties_as_half(spark):
    rows = [(0.2, 0), (0.2, 1), (0.9, 1), (0.1, 0), (0.5, 0), (None, 1), (0.4, None)]
    r = ranges.auc_and_brier(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    known = [(s, y) for s, y in rows if s is not None and y is not None]
    won = [(a > b) + (a == b) / 2 for a, p in known if p for b, q in known if not q]
    assert r.n == 5 and r.auc == pytest.approx(sum(won) / len(won)) and r.brier == pytest.approx(sum((s - y) ** 2 for s, y in known) / 5)
    assert ranges.auc_and_brier(spark.createDataFrame([(0.2, 1)], "s double, y int"), "s", "y").first().auc is None


def test_similarities():
    assert S.osa("ca", "abc") == 3 and S.osa("abcd", "acbd") == 1 and S.osa("", "ab") == 2 and S.osa("", "") == 0
    assert S.partial("ring", "small ring box") == 1 and S.partial("", "a") == 0 and S.partial("", "") == 1
    assert S.token_set("red small ring", "ring, small") == 1 and S.token_set("a", "") == 0
    assert S.token_set("red ring", "blue ring") == pytest.approx(max(S.indel_ratio("ring", "ring red"), S.indel_ratio("ring", "ring blue"), S.indel_ratio("ring red", "ring blue")))
    assert S.weighted("small ring", "ring small") == 0.95 and S.weighted("ring", "one ring in a very long list of other things, far longer than eight times") == 0.6
    assert S.plain("A-b", "a b") == 1 and S.plain("", "") == 0


def test_cosine_top_k(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", 40)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(90)] + [(100, [0.0] * 6), (120, None), (140, [1.0]), (160, [2.0]), (None, [1.0] * 6), (200, rng.normal(size=6).tolist()), (220, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    found = {(r.query_id, r.vec_id, r.cosine) for r in neighbours.cosine_top_k(df, F.col("vec_id") % 20 == 0, "vec_id", "e", 4).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v is not None and any(v)}
    expected = set()
    for q, x in good.items():
        if q % 20 == 0:
            near = sorted((-(round(float(x @ y), 6) + 0.0), i) for i, y in good.items() if i != q and len(x) == len(y))[:4]
            expected |= {(q, i, -s) for s, i in near}
    assert {(q, i) for q, i, _ in found} == {(q, i) for q, i, _ in expected}
    assert neighbours.cosine_top_k(df.limit(0), F.col("vec_id") % 20 == 0, "vec_id", "e", 4).count() == 0


def test_fills_and_dummies(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 1, None)], "k string, t int, v string")
    out = R.fill(R.fill(df, ["k"], ["t"], "v", "f"), ["k"], ["t"], "v", "b", forward=False).orderBy("k", "t").collect()
    assert [(r.f, r.b) for r in out] == [(None, "x"), ("x", "x"), ("x", None), (None, None)]
    assert [(r.is_x, r.is_y) for r in R.dummies(df, "v", ["x", "y"], "is").orderBy("k", "t").collect()] == [(0, 0), (1, 0), (0, 0), (0, 0)]


def test_check_unique(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert R.check_unique(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="a key repeats"):
        R.check_unique(df.union(df), ["k"]).collect()


def test_best_path_and_scores_of_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1.4), (1, 2, -0.2), (1, 3, None)], "a int, b int, s double")
    out = {(r.a, r.b): (r.s, r.path) for r in C.best_path([(df, "one"), (df.withColumn("s", F.lit(1.0)).where("b = 1"), "two")], ["a", "b"], "s").collect()}
    assert out == {(1, 1): (1.0, "one"), (1, 2): (0.0, "one")}
    none = F.lit(None).cast("double")
    assert spark.range(1).select(C.country_score(none, none, none, none, 0.5).alias("s")).first().s == 0
    assert not spark.range(1).select(C.alias_gate(F.lit(None).cast("string"), F.lit("a")).alias("s")).first().s


def test_index_models_beat_chance(spark, sf_dir):
    rng = np.random.default_rng(6)
    x = rng.normal(size=600)
    rows = [(int(i), float(v), float(v + rng.normal() > 0)) for i, v in enumerate(x)] + [(900, None, 1.0)]
    from loomspan.operators.index_models import compare

    found = compare(spark.createDataFrame(rows, "k long, x double, y double"), "k", "y", ["x"]).collect()
    assert {r.model for r in found} == {"linear", "lasso", "logit", "poisson", "forest"}
    assert all(r.auc > 0.65 and r.brier < 0.25 for r in found)
    assert compare(spark.createDataFrame([], "k long, x double, y double"), "k", "y", ["x"]).count() == 0


def test_flows_of_candidates_run_on_empty_tables(spark):
    none = spark.createDataFrame([], "u long, t int, b long")
    assert C.verified(none, none, "u", "t").count() == 0
    assert C.control_pool(none, none, none, ["b"], "u", "t", 1).count() == 0
    assert catalogue.queries()["optimal_match"] is not None
