"""Near copies: a crowd that shares shingles but isn't alike makes few pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomspan.llm import near_copies as N
from loomspan.llm.simhash import forest


def test_sketches_drop_no_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 900):
        for _ in range(60):
            whole = rng.integers(0, 2**63, size=2 * n, dtype=np.uint64)
            a, b = np.unique(whole[:n]), np.unique(np.concatenate((whole[: n - n // int(rng.integers(2, 12))], whole[n : n + int(rng.integers(0, n // 8 + 1))])))
            near = N._near(np.array([len(a)]), np.array([len(b)]), list(N.sketch(a)[:, None]), list(N.sketch(b)[:, None]), (4, 5))
            assert near[0] or not N.similar(a, b, (4, 5))


def test_crowd_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(40))
    # all share a passage; every second one has a copy with a word more
    own = [" ".join(word() for _ in range(7)) for _ in range(120)]
    rows = [(2 * i, f"{passage} {t}") for i, t in enumerate(own)] + [(2 * i + 1, f"{passage} {t} {word()}") for i, t in enumerate(own) if i % 2]
    seen, whole = [], N._confirmed
    monkeypatch.setattr(N, "_confirmed", lambda pairs, *more: seen.append(pairs.count()) or whole(pairs, *more))
    found = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: N.shingles(t.encode()) for i, t in rows}
    expected = {i: next(j for j in sorted(sets) if N.similar(sets[i], sets[j], (4, 5))) for i in sets}
    assert {r.doc_id: r.component_id for r in found} == expected
    assert sum(seen) <= 4 * len(rows)


def test_forests_lose_no_link():
    rng = np.random.default_rng(1)
    for _ in range(20_000):
        n = int(rng.integers(2, 30))
        a, b = rng.integers(0, n, (2, int(rng.integers(1, 40))))
        a, b = a[a != b], b[a != b]
        expected = np.arange(n)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            low, high = sorted((expected[x], expected[y]))
            expected[expected == high] = low
        assert (forest(n, a, b) == expected).all()


def test_few_links_take_few_stages(spark, monkeypatch):
    monkeypatch.setattr(N, "connected_components", lambda links: pytest.fail("few links went through rounds"))
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(-7, 900), (5, 5), (77, 77)], "a long, b long")
    assert {r.node: r.root for r in N._roots(links).collect()} == {**dict.fromkeys(range(41), 0), -7: -7, 900: -7}


def test_rounds_and_one_task_agree(spark, monkeypatch):
    rng = random.Random(3)
    links = spark.createDataFrame([(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(260)], "a long, b long")
    at_once = sorted(N._roots(links).collect())
    monkeypatch.setattr(N, "AT_ONCE", 0)
    assert sorted(N._roots(links).collect()) == at_once
