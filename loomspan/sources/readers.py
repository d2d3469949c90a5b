"""Reading tables from files and databases, and writing them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.relational import append_aligned


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One or more paths or globs."""
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, text_only: bool = False) -> DataFrame:
    """CSV with a header; ``text_only`` leaves every column text, which also
    saves the pass that finds types."""
    return spark.read.csv(path, header=True, inferSchema=not text_only, escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """JSON lines, or one document a file where ``whole``."""
    return spark.read.json(path, multiLine=whole)


def read_json_lookup(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object of text values as a table of ``key, value``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def read_aligned(spark: SparkSession, paths: list[str], schema: Mapping[str, str], kind: str = "parquet") -> DataFrame:
    """Files whose columns differ as one table of ``schema``: absent columns
    are null, others go, values that don't fit become null."""
    frames = [spark.read.format(kind).option("header", "true").load(p) for p in paths]
    return append_aligned(frames, dict(schema))


def key_ranges(low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """Closed ranges that split [low, high] evenly; fewer if it is short."""
    n = high - low + 1
    shards = max(1, min(shards, n))
    cuts = [low + n * i // shards for i in range(shards + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def read_jdbc(spark: SparkSession, url: str, query: str, key: str, low: int, high: int, shards: int, **options: str) -> DataFrame:
    """A database query in ``shards`` parallel key ranges; the database
    filters each range itself."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    ends = {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(shards)}
    return reader.options(**ends).load()


def rows_of(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``ids``, however many those are."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def append_new(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` with keys that ``stored`` lacks, once each: what an
    insert that does nothing on conflict would add."""
    return df.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def cached(spark: SparkSession, path: str, fingerprint: Mapping[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was built from the same ``fingerprint``,
    else built and written there. The fingerprint goes in a table beside it,
    last, so a build that broke off isn't taken for whole."""
    mark, said = f"{path}.fingerprint", json.dumps(fingerprint, sort_keys=True, default=str)
    try:
        if [r["value"] for r in spark.read.text(mark).collect()] == [said]:
            return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV parts with headers; a report of a few rows is one part."""
    df.write.mode(mode).csv(path, header=True)
