"""The best rows of each row's block, without any pair of rows."""

from __future__ import annotations

import random

import pytest
from conftest import plain

from loomspan.operators import linkage as L
from loomspan.plans import catalogue

SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def _rows() -> list[tuple]:
    """A crowded block, small ones, rows without a block or without a name."""
    rng = random.Random(5)
    names = ["large ring", "ring large", "blue bolt", "bolt", "bolt x", None]
    rows = [(i, rng.choice(names), rng.choice(["Brand#1"] * 8 + ["Brand#2", None]), rng.choice(["SMALL", "LARGE", "LARGE BOX"]), rng.choice([1, 1, 1, 2, None]), 9.0) for i in range(400)]
    return [*rows, (-5, "alone", "Brand#9", "SMALL", 1, 9.0), (900, "two", "Brand#8", "SMALL", 1, 9.0), (901, "twos", "Brand#8", "LARGE", 1, 9.0)]


@pytest.mark.parametrize("size", [4_000_000, 500])
def test_topn_is_that_of_all_pairs(spark, tmp_path, monkeypatch, size):
    import duckdb

    monkeypatch.setattr(L, "SLICE", size)
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(f"{tmp_path}/part.parquet")
    seen, whole = [], L.best_pairs

    def spied(rows, block, key, left, right, rank, k, score):
        return whole(rows, block, key, left, right, lambda p: seen.append(p.count()) or rank(p), k, score)

    monkeypatch.setattr(L, "best_pairs", spied)
    found = catalogue.queries()["lev_topn_match"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert plain(found) == plain(con.execute(catalogue.oracle_sql()["lev_topn_match"]).df())
    assert sum(seen) <= 21 * 21


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/part.parquet")
    assert catalogue.queries()["lev_topn_match"](spark, str(tmp_path)).count() == 0
