"""Matching and gazetteers where rows or keys crowd."""

from __future__ import annotations

import random

import pytest

from loomspan.operators import assignment as A
from loomspan.operators import candidates as C



@pytest.mark.parametrize("k", [1, 2])
def test_nearest_against_all_pairs(spark, k):
    rng = random.Random(11)
    # copies, close values whose distances round to one, own rows in the pool, empty cells
    pick = lambda: rng.choice([float(rng.randrange(12)), rng.random() * 1e-17, 5.0 + rng.randrange(4) * 2**-51, -500.0 - rng.randrange(9) * 2**-44, None, float("nan")])
    treated = [(rng.choice([0, 1, 2, None]), i, pick()) for i in range(60)]
    pool = treated[:20] + [(rng.choice([0, 1, None]), 100 + i, pick()) for i in range(90)]
    schema = "c int, k long, v double"
    found = A.nearest(spark.createDataFrame(treated, schema), spark.createDataFrame(pool, schema), ["c"], "k", "v", 600.0, k)
    expected = []
    for c, key, v in treated:
        near = sorted((abs(v - w), m) for e, m, w in pool if c is not None and e == c and m != key and None not in (v, w) and abs(v - w) <= 600)
        expected += [(c, key, m, x, n) for n, (x, m) in enumerate(near[:k], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_nearest_meets_few_of_a_cell(spark, monkeypatch):
    kept, whole = [], A.settle
    monkeypatch.setattr(A, "settle", lambda df, name: kept.append((name, whole(df, name))) or kept[-1][1])
    pool = spark.range(3000).selectExpr("0 AS c", "id + 1000 AS k", "cast(id % 50 AS double) AS v")
    treated = spark.range(200).selectExpr("0 AS c", "id AS k", "cast(id % 50 AS double) + 0.25 AS v")
    assert A.nearest(treated, pool, ["c"], "k", "v", 40.0).count() == 200
    values, met = (dict(kept)[n] for n in ("values", "nearest"))
    assert values.count() == 50 and met.count() == 200 and not met.where("_open").take(1)


def test_gazetteer_runs_by_rows(spark):
    texts = spark.createDataFrame([(1, "In  New York City and York"), (2, ""), (3, None), (4, "x " * 20 + "york")], "k long, t string")
    places = spark.createDataFrame([("New York",), ("new york city",), ("York",), (None,), ("York",)], "p string")
    found = C.gazetteer_hits(texts, "k", "t", places, "p", 3)
    assert sorted(map(tuple, found.collect())) == [(1, "York", 1, 3), (1, "York", 1, 6), (1, "new york city", 3, 2), (4, "York", 1, 21)]
    assert "transform(" not in found._jdf.queryExecution().analyzed().toString()
