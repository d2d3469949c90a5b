"""Tables in the folder that executors and driver share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, where no shared folder is named, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/loomspan"

#: Spark's own switch: a query's shuffle files go when the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names. Where it
    is unset, only a local master has a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that start and end inside leave no shuffle files behind."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which ends its
    lineage and keeps it when executors are lost."""
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, name), df.schema
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            jvm = df.sparkSession.sparkContext._jvm
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
