"""Queries over pairs of rows score each two texts once, and lose no pair."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from conftest import plain

from loomspan.functions import similarity as S
from loomspan.operators import linkage as L
from loomspan.plans import catalogue
from loomspan.plans.texts import _PAIRS

#: By query: the plain score of two texts where no SQL states it.
QUERIES = ["dl_match", "alias_gate", "jaro_match", "jw_blocked_match", "three_path_pairs", "token_sort_match", "osa_rules", "token_ratios", "lev_within_bound"]
ROWS = 240


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Two blocks of many rows and few texts, and a row without a block."""
    d = tmp_path_factory.mktemp("crowded")
    names, kinds = ("large ring", "ring large", "blue bolt", "bolt"), ("SMALL", "LARGE")
    rows = [(i, names[i * i % 7 % 4], f"Brand#{i % 2}", kinds[i % 3 % 2], 1 + i % 2, 9.0) for i in range(ROWS)]
    rows.append((ROWS, "bolt", None, "SMALL", 1, 9.0))
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_texts_are_scored_once(spark, crowded, monkeypatch, name):
    import duckdb

    seen, whole = [], L.scored_pairs

    def spied(rows, block, key, left, right, score):
        return whole(rows, block, key, left, right, lambda p: seen.append(p.count()) or score(p))

    monkeypatch.setattr(L, "scored_pairs", spied)
    found = catalogue.queries()[name](spark, crowded).toPandas()
    texts = len({(x, y) for x, y in spark.read.parquet(f"{crowded}/part.parquet").select("p_name", "p_type").collect()})
    assert seen and sum(seen) <= texts * texts
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{crowded}/part.parquet/*.parquet'")
    if sql := catalogue.oracle_sql().get(name):
        assert plain(found) == plain(con.execute(sql).df())
    else:
        assert plain(found) == plain(EXPECTED[name](con))


def _plainly(con, columns: dict) -> pd.DataFrame:
    """All pairs, each scored on its own."""
    p = con.execute(f"WITH {_PAIRS} SELECT * FROM p").df()
    for name, f in columns.items():
        p[name] = [f(a, b) for a, b in zip(p["a"], p["b"], strict=True)]
    return p[["a_key", "b_key", *columns]]


def _osa(con) -> pd.DataFrame:
    p = _plainly(con, {"osa": S.osa})
    n = con.execute("SELECT p_partkey AS a_key, count(*) OVER (PARTITION BY p_name, p_type) AS n FROM part").df()
    p = p.merge(n, on="a_key")
    return p[(p["osa"] <= 2) | (p["n"] >= math.e**2)][["a_key", "b_key", "osa"]]


def _partly(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    return max(_ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


def _ratios(con) -> pd.DataFrame:
    """Names and kinds are words without marks, so keys are lower case."""
    key = str.lower
    columns = {"plain": lambda a, b: _ratio(key(a), key(b)), "token_set": S.token_set, "partial": _partly, "weighted": S.weighted}
    return _plainly(con, {k: lambda a, b, f=f: round(f(a, b), 4) for k, f in columns.items()})


def test_ratio_by_bits():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc é", k=rng.randrange(90))) for _ in "ab")
        assert S.indel_ratio(a, b) == (_ratio(a, b) if a or b else 1.0)
        if a and b:
            assert S.partial(a[:12], b[:30]) == _partly(a[:12], b[:30])


def _lcs(a: str, b: str) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def _ratio(a: str, b: str) -> float:
    return 2 * _lcs(a, b) / (len(a) + len(b))


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


EXPECTED = {
    "token_ratios": _ratios,
    "osa_rules": _osa,
    "token_sort_match": lambda con: _plainly(con, {"ratio": lambda a, b: round(_ratio(_sorted(a), _sorted(b)), 6)}),
}
