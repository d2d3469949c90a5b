"""osa_rules: a pair's result doesn't depend on the size of its table."""

from __future__ import annotations

from itertools import combinations

from loomspan.functions import similarity as S
from loomspan.plans.census import osa_rules

TEXTS = [("ring", "ring"), ("ab", "ba"), ("large ring", "SMALL"), ("bolt", "LARGE"), ("large ring", "SMALL")]


def _found(spark, path: str, times: int) -> dict:
    rows = [(i + 100 * t, *TEXTS[i], "Brand#1", 1) for t in range(times) for i in range(len(TEXTS))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    found = osa_rules(spark, path).collect()
    kept = {(r.a_key, r.b_key): r.osa for r in found}
    assert len(found) == len(kept)
    assert kept == {(a[0], b[0]): S.osa(f"{a[1]} {a[2]}", f"{b[2]} {b[1]}") for a, b in combinations(sorted(rows), 2)}
    return {k: v for k, v in kept.items() if max(k) < 100}


def test_repeated_rows_change_no_pair(spark, tmp_path):
    assert _found(spark, f"{tmp_path}/once", 1) == _found(spark, f"{tmp_path}/often", 9)
