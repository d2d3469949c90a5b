"""A corpus pipeline over documents; counted as part of loomspan.llm.

Each stage takes the documents that the one before kept and returns the
columns of documents; the last returns packed pieces. Rows without a doc_id
can't be named by a decision and stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import mixing, packing, simhash, substring_dedup
from loomspan.llm import toxicity as toxicity_chain
from loomspan.llm.queries import tokenizer_path, toxicity_categories, with_quality
from loomspan.storage import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and every other column in one, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("."), *others).alias("_carried"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents again, in their order."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_carried").getField(c).alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity_chain.toxicity(carried(docs), labels, toxicity_categories(), keep=("text", "_carried"))
    return unpacked(judged.where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id.
    Groups are linked by runs of five words at a similarity of 0.8 or more."""
    found = simhash.near_duplicates(docs, width=5, similarity=(4, 5))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a smaller doc_id has too are cut out; a text
    that loses none stays as it is. Every document stays."""
    done = substring_dedup.remove_repeats(carried(docs), window=13, keep=("text", "_carried"))
    cut = F.col("n_removed") > 0
    n_chars = F.length("kept_text").cast("long")
    done = done.withColumn("_text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    columns = [
        F.col("_text").alias("text") if c == "text" else F.col("doc_id") if c == "doc_id"
        else F.when(cut, n_chars).otherwise(F.col("_carried").getField(c)).alias(c) if c == "n_chars"
        else F.col("_carried").getField(c).alias(c) for c in docs.columns
    ]
    return done.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; alike rows share copies."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(with_quality(mixing.draw(docs), labels), F.col("_quality"))
    taken = mixed.groupBy(F.col("row_key").alias("_row")).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_alike"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), mixing.row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    both = keyed.join(taken.where("_sum > 0"), F.col("_key") == F.col("_row"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    each = F.floor(F.col("_sum") / F.col("_alike")) + (nth <= F.col("_sum") % F.col("_alike")).cast("long")
    both = both.withColumn("_times", each).where(F.col("_times") > 0)
    return both.select(F.explode(F.array_repeat("_doc", F.col("_times").cast("int"))).alias("_doc")).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", remove_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL can express neither the trained chain nor the packing; the tests hold
#: the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
