"""The pipeline's near-dedup stage against all pairs of planted copies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def planted(rng):
    rows = []
    for base in range(12):
        words = [f"b{base}w{k}" for k in rng.integers(0, 400, [30, 100, 300][base % 3])]
        rows.append(" ".join(words))
        for edits in (1, 1, 2, 4, 6, 9):
            copy = list(words)
            for at in rng.integers(0, len(words), edits):
                copy[at] = f"e{rng.integers(0, 1 << 30)}"
            rows.append(" ".join(copy))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [passage + " " + " ".join(f"o{i}x{k}" for k in range(int(n))) for i, n in enumerate(rng.integers(1, 30, 30))]
    rows += [rows[0], rows[0].upper(), None, "", " \n", "a b", "A  b", "a c"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)] + [(None, rows[3])]


def components(rows):
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return {i: least[g] for g, (i, _) in zip(group, rows, strict=True) if i is not None}


def test_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rows = planted(np.random.default_rng(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = components(rows)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").where(F.col("doc_id").isNotNull()).collect()}
    assert kept == {i for i, c in expected.items() if i == c}
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_crowded_files_lose_no_pair(spark, monkeypatch):
    from loomspan.llm import near_copies

    monkeypatch.setattr(near_copies, "SMALL", 2)
    rows = planted(np.random.default_rng(12))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect() if r.doc_id is not None}
    assert found == components(rows)
