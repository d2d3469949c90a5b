"""The registered queries against their SQL, and the pipeline's stages
against plain versions of what they keep."""

from __future__ import annotations

import pytest
from conftest import plain
from pyspark.sql import functions as F

from loomspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    found = queries.queries()[name](spark, sf_dir).toPandas()
    assert plain(found) == plain(duck.execute(queries.oracle_sql()[name]).df())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline
    from loomspan.storage import settle

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "source_mix", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(settle(stage(spark, kept[-1], sf_dir), name))
    columns = docs.columns
    assert all(k.columns == columns for k in kept[:-1])
    judged = queries.op9_toxicity_chain(spark, sf_dir)
    assert kept[1].count() == judged.where("kept").count()
    # after near-dedup no fingerprint is left twice
    from loomspan.llm import simhash

    again = simhash.near_duplicates(kept[2])
    assert again.count() == again.select("component_id").distinct().count()
    # after substring dedup no window of 13 words starts in two documents
    assert kept[3].count() == kept[2].count()
    grams = kept[2].select("doc_id", F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ").alias("w")).where(F.size("w") >= 13)
    grams = grams.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 12), lambda i: F.array_join(F.slice("w", i, F.lit(13)), " "))).alias("g"))
    twice = grams.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    lost = grams.join(twice, "g").where("doc_id > a").select("doc_id").distinct()
    changed = kept[2].join(kept[3].select("doc_id", F.col("text").alias("now")), "doc_id").where("text != now").select("doc_id")
    assert {r.doc_id for r in lost.collect()} == {r.doc_id for r in changed.collect()}
    # the mix repeats rows at most twice, and packing holds all of them
    assert kept[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert kept[5].where("piece = 0").count() == kept[4].count()
    assert kept[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a"), (2, "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a"),
    (3, None, None), (4, "", "b"), (None, "no id at all", "b"), (5, "a b", "a"), (5, "a b", "a"), (6, "a  b", "c"), (7, "long " * 3000, "c"),
]
CLASHES = ("n_words", "kept", "kept_text", "toxic", "_row", "_key", "_doc", "_carried", "_times", "row_key", "component_id", "fingerprint", "size", "_quality", "a.b", "node", "_id")


@pytest.mark.parametrize("stage", range(5))
def test_stages_carry_columns_of_any_name(spark, sf_dir, stage):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat_ws("/", F.lit(c), "doc_id"))
    name, run = pipeline.STAGES[stage]
    found = run(spark, docs, sf_dir)
    if stage == 4:
        assert found.where("piece = 0").count() == len(ROWS)
        assert run(spark, docs.limit(0), sf_dir).count() == 0
        return
    assert found.columns == docs.columns
    rows = found.collect()
    assert all(r[c] == "/".join([c] + ([str(r["doc_id"])] if r["doc_id"] is not None else [])) for r in rows for c in CLASHES)
    ids = sorted(str(r["doc_id"]) for r in rows)
    every = sorted(str(i) for i, _, _ in ROWS)
    if stage == 0:  # none of these is toxic
        assert ids == every and {(r["doc_id"], r["text"]) for r in rows} == {(i, t) for i, t, _ in ROWS}
    elif stage == 1:  # 2 nearly repeats 1 (10 of 11 runs), 4 has no words like 3, 6 has the words of 5
        assert ids == ["1", "3", "5", "5", "7", "None"]
    elif stage == 2:
        assert ids == every and {r["doc_id"]: r["text"] for r in rows}[2] == "x" and {r["doc_id"]: r["n_chars"] for r in rows}[2] == 1
    assert run(spark, docs.limit(0), sf_dir).count() == 0
