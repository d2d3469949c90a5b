"""Mixing sources to target weights with Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import WORD
from loomspan.operators.ranges import running_total
from loomspan.storage import settle

#: Sources are few; beyond this the table of targets isn't one for the driver.
MAX_SOURCES = 100_000


def fill_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares ``total`` by weight; a share above ``cap`` times its size stops
    there and the excess is shared again among the others, until none is."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = min(total, cap * sum(sizes))
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if scale * weights[i] >= cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = scale * weights[i]
            return out
        for i in full:
            out[i] = cap * float(sizes[i])
            left -= out[i]
        closed = set(full)
        open_ = [i for i in open_ if i not in closed]
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """An MD5 of id and text; nulls are empty."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, row_key, _u`` of every row, without its text:
    the words that it has, an MD5 of id and text that tells rows apart, and a
    number in (0, 1) from that."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), key.alias("row_key"))
    u = (F.conv(F.substring("row_key", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return rows.withColumn("_u", u)


def mix(drawn: DataFrame, quality: Column, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per row of ``drawn`` (see ``draw``): ``doc_id, size, source,
    source_size, target, copies, taken, row_key``.

    Sources, in code-point order with null last, take the weights of ``cycle``
    in turn. A source's whole epochs come first; for the rest each row draws
    the exponential key -ln(u) / quality, and rows are taken in key order
    until the running size is as near the rest as whole rows allow.

    Null text counts no words; a row without words is copied with its epochs
    but takes none of the target. ``quality`` null or not above 0 counts as 1.
    Repeated rows are rows of their own; ties in the key go by id. An empty
    table gives an empty result.
    """
    spark = drawn.sparkSession
    drawn = settle(drawn.withColumn("_quality", quality.cast("double")), "drawn")
    quality = F.col("_quality")
    weight = F.when(quality > 0, quality).otherwise(F.lit(1.0)).cast("double")
    rows = drawn.select("doc_id", "source", "size", "row_key", (-F.log("_u") / weight).alias("_key"))
    placed = running_total(rows, ["_key", "doc_id", "size"], F.col("size"), "_before", ["source"])
    found = drawn.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in found]
    targets = fill_targets(sizes, [float(cycle[i % len(cycle)]) for i in range(len(sizes))], share * sum(sizes), cap)
    table = spark.createDataFrame(
        [(r["source"], n, float(t)) for r, n, t in zip(found, sizes, targets, strict=True)],
        "_source string, source_size long, target double",
    )
    placed = placed.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    placed = placed.withColumn("_epochs", epochs)
    extra = ((F.col("size") > 0) & (2 * F.col("_before") + F.col("size") <= 2 * rest)).cast("long")
    placed = placed.withColumn("copies", F.col("_epochs") + extra)
    return placed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_key")
