"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal
passages cut alike wherever they stand. The store is three Parquet tables:

``raw/kind=chunk``  address (SHA-256 of the ids as little-endian unsigned 32-bit
               numbers), n_ids, payload (the ids as little-endian unsigned
               16- or 32-bit numbers, zstd); each address once.
``recipes``    doc_id, row_id, start, n_tokens, parts (the addresses one after
               the other), root (the Merkle root of the parts), in ascending
               (doc_id, row_id), over files in ascending ranges.
``manifests``  file, n_docs, n_ids, root: for each range of recipes the Merkle
               root over its documents' roots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.shared import slices, spread, texts_of
from loomspan.llm.tokens import encoder
from loomspan.operators.ranges import running_total
from loomspan.storage import scratch_path, shuffles_removed

END_ID = 0
#: Ids that the rolling hash sees, the mask that a cut needs (one cut in 512
#: places), and the bounds of a chunk's length.
WINDOW, MASK, LEAST, MOST = 16, 0x1FF, 64, 4096
FACTOR = 0x9E3779B97F4A7C15


def marks(ids: np.ndarray) -> np.ndarray:
    """Places where the rolling hash of the last ``WINDOW`` ids asks for a cut."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    mixed ^= mixed >> np.uint64(29)
    power, span = 0xBF58476D1CE4E5B9, 1
    rolled = mixed * np.uint64(power)
    while span < WINDOW:  # the hash of twice as many ids, from those of the halves
        late = rolled[:-span] * np.uint64(power)
        rolled = rolled.copy()
        rolled[span:] += late
        power, span = power * power % (1 << 64), 2 * span
    return np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cuts(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of the streams that ``ids`` holds one after
    the other. ``LEAST`` exceeds the window, so no cut depends on the stream
    before."""
    found, out = marks(ids), []
    ends = np.cumsum(lengths)
    first = np.searchsorted(found, ends - lengths, side="right").tolist()
    past = np.searchsorted(found, ends, side="right").tolist()
    for start, n, a, b in zip((ends - lengths).tolist(), lengths.tolist(), first, past, strict=True):
        own, last = [], 0
        for m in [*(found[a:b] - start).tolist(), n]:
            while m - last > MOST:
                last += MOST
                own.append(last)
            if m - last >= LEAST or m == n and m > last:
                own.append(m)
                last = m
        out.append(own)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root over digests: pairs are hashed with a node mark, an odd last
    one goes up as it is; no leaves give the digest of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        nodes = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = nodes + level[len(level) - len(level) % 2 :]
    return level[0]


def encode_payload(ids: np.ndarray, codec: zstandard.ZstdCompressor) -> bytes:
    small = not len(ids) or int(ids.max()) < 65_536
    return (b"\x02" if small else b"\x04") + codec.compress(ids.astype("<u2" if small else "<u4").tobytes())


def decode_payload(payload: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(payload[1:])
    return np.frombuffer(raw, dtype="<u2" if payload[:1] == b"\x02" else "<u4").astype("<u4")


def _times(matrix: Sequence[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _crc_powers(levels: int = 48) -> list[list[int]]:
    """Matrices over GF(2) that append 1, 2, 4, ... zero bytes to a CRC-32."""
    one_bit = [0xEDB88320, *[1 << k for k in range(31)]]
    two = [_times(one_bit, x) for x in one_bit]
    four = [_times(two, x) for x in two]
    byte = [_times(four, x) for x in four]
    out = [byte]
    for _ in range(levels - 1):
        out.append([_times(out[-1], x) for x in out[-1]])
    return out


_POWERS = _crc_powers()


@lru_cache(maxsize=8192)
def _append_zeros(size: int) -> tuple[int, ...]:
    """The matrix that appends ``size`` zero bytes to a CRC-32."""
    out = [1 << k for k in range(32)]
    for k in range(size.bit_length()):
        if size >> k & 1:
            out = [_times(_POWERS[k], x) for x in out]
    return tuple(out)


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of byte strings one after the other, from each one's CRC-32
    and length."""
    total = 0
    for crc, size in parts:
        total = (_times(_append_zeros(size), total) if total else 0) ^ crc
    return total


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", spaced: bool = True) -> None:
    """Encodes every row's text, appends the end id and writes the store.

    Null text is empty (the end id alone). Repeated rows are documents of
    their own and share their chunks; equal ids order by the rows' content. A
    null doc_id sorts first. An empty table writes empty tables. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer = encoder(tokenizer, spaced), zstandard.ZstdCompressor(level=1)
        end = np.array([END_ID], dtype="<u4").tobytes()
        kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("parts", pa.binary()), ("address", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary())]
        for batch in slices(batches, "text", 8 << 20):
            rows: list[list] = [[] for _ in kinds]
            seen: set[bytes] = set()
            streams = [s + end for s in codec.encode(texts_of(batch, "text"))]
            places = cuts(np.frombuffer(b"".join(streams), dtype="<u4"), np.array([len(s) // 4 for s in streams], dtype=np.int64))
            for doc, stream, own in zip(batch.column(0).to_pylist(), streams, places, strict=True):
                ids, last, parts = np.frombuffer(stream, dtype="<u4"), 0, []
                for at in own:
                    address = hashlib.sha256(stream[4 * last : 4 * at]).digest()
                    parts.append(address)
                    if address not in seen:
                        seen.add(address)
                        for out, x in zip(rows, (None, None, None, address, at - last, encode_payload(ids[last:at], packer)), strict=True):
                            out.append(x)
                    last = at
                for out, x in zip(rows, (doc, len(ids), b"".join(parts), None, None, None), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(rows, kinds, strict=True)], [n for n, _ in kinds])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = rows.mapInArrow(run, "doc_id long, n_tokens long, parts binary, address binary, n_ids int, payload binary")
    # Payloads move once, to where their address belongs; of equal ones the
    # first is written. A batch has each chunk once, so a passage that all
    # documents share moves once a batch. Recipes go along, dealt by content.
    dealt = encoded.withColumn("kind", F.when(F.col("address").isNull(), "recipe").otherwise("chunk"))
    dealt = dealt.repartition(spread(docs), F.xxhash64("address", "parts")).sortWithinPartitions("kind", "address")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for address in batch.column(batch.schema.get_field_index("address")).to_pylist():
                keep.append(address is None or address != last)
                last = address
            yield batch.filter(pa.array(keep, pa.bool_()))

    with shuffles_removed(spark):
        dealt.mapInArrow(once, dealt.schema).write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{path}/raw")
    schema = "doc_id long, n_tokens long, parts binary"
    recipes = spark.read.schema(f"{schema}, kind string").parquet(f"{path}/raw").where(F.col("kind") == "recipe").drop("kind")
    recipes = recipes.withColumn("row_id", F.xxhash64("parts"))
    total = running_total(recipes, ["doc_id", "row_id"], F.col("n_tokens"), "start")

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(batch.schema.get_field_index("parts")).to_pylist()
            roots = [merkle([p[i : i + 32] for i in range(0, len(p), 32)]) for p in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])

    total = total.select("doc_id", "row_id", "start", "n_tokens", "parts")
    schema = "doc_id long, row_id long, start long, n_tokens long, parts binary, root binary"
    ordered = total.repartitionByRange(spread(docs), "start").sortWithinPartitions("start").mapInArrow(rooted, schema)
    with shuffles_removed(spark):
        ordered.write.option("compression", "uncompressed").parquet(f"{path}/recipes")
        _manifests(spark.read.schema(schema).parquet(f"{path}/recipes")).write.parquet(f"{path}/manifests")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.schema("address binary, n_ids int, payload binary, kind string").parquet(f"{path}/raw")
    return table.where(F.col("kind") == "chunk").drop("kind")


def _file() -> Column:
    """The name of the file that a row was read from."""
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def _manifests(recipes: DataFrame) -> DataFrame:
    """One row per recipe file: the Merkle root over its documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, roots, ids = None, [], 0

        def row() -> pa.RecordBatch:
            values = [[name], [len(roots)], [ids], [merkle(roots)]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "n_docs", "n_ids", "root"])

        for batch in batches:
            for file, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name is not None and file != name:
                    yield row()
                    roots, ids = [], 0
                name = file
                roots.append(root)
                ids += n
        if name is not None:
            yield row()

    named = recipes.select(_file().alias("file"), "start", "n_tokens", "root")
    dealt = named.repartition("file").sortWithinPartitions("file", "start").select("file", "n_tokens", "root")
    return dealt.mapInArrow(run, "file string, n_docs long, n_ids long, root binary")


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """``file, ok``: whether each manifest's root follows from the recipes."""
    stored = spark.read.parquet(f"{path}/manifests").select("file", F.col("root").alias("said"))
    found = _manifests(spark.read.parquet(f"{path}/recipes"))
    return stored.join(found, "file", "full").select("file", F.coalesce(F.col("said") == F.col("root"), F.lit(False)).alias("ok"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_chunks, verified`` of every
    document, from the files.

    Every chunk is decoded and its address, length and CRC-32 computed from
    its ids; a document's CRC-32 follows from its chunks' by the algebra of
    CRCs, so payloads needn't travel. ``verified``: every part is stored, has
    the digest that its address states, the lengths add up, the recipe has
    its Merkle root, and its file has the root that the manifest states.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            address, payload = (c.to_pylist() for c in batch.columns)
            streams = [decode_payload(p).tobytes() for p in payload]
            cols = [address, [len(s) // 4 for s in streams], [zlib.crc32(s) for s in streams], [hashlib.sha256(s).digest() == a for a, s in zip(address, streams, strict=True)]]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["address", "n", "crc", "same"])

    chunks = _chunks(spark, path).select("address", "payload").mapInArrow(decoded, "address binary, n long, crc long, same boolean")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, parts, root = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lists = [[p[i : i + 32] for i in range(0, len(p), 32)] for p in parts]
            good = np.array([merkle(x) == r for x, r in zip(lists, root, strict=True)], dtype=bool)
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cols = (np.repeat(start, sizes), nth.astype(np.int32), pa.array(chain.from_iterable(lists), pa.binary()), np.repeat(good, sizes))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["start", "k", "address", "good"])

    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("start", "parts", "root").mapInArrow(parted, "start long, k int, address binary, good boolean")
    # a part as one number: its length and its CRC-32
    part = F.struct("k", F.shiftleft(F.coalesce("n", F.lit(0)), 32).bitwiseOR(F.coalesce("crc", F.lit(0))).alias("x"))
    found = parts.join(chunks, "address", "left").groupBy("start").agg(
        F.transform(F.sort_array(F.collect_list(part)), lambda p: p["x"]).alias("list"),
        F.min(F.col("good") & F.coalesce("same", F.lit(False))).alias("whole"),
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            crcs = (flat & 0xFFFFFFFF).tolist()
            sizes = flat >> 32
            total = np.concatenate(([0], np.cumsum(sizes)))
            pairs = list(zip(crcs, (4 * sizes).tolist(), strict=True))
            whole = [join_crcs(pairs[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            cols = [batch.column(0), pa.array(whole, pa.int64()), pa.array(total[ends[1:]] - total[ends[:-1]]), pa.array(np.diff(ends).astype(np.int32)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, ["_start", "ids_crc32", "n_read", "n_chunks", "whole"])

    found = found.mapInArrow(joined, "_start long, ids_crc32 long, n_read long, n_chunks int, whole boolean")
    named = recipes.select("doc_id", "start", "n_tokens", _file().alias("file"))
    both = named.join(found, F.col("start") == F.col("_start")).join(verify_store(spark, path), "file", "left")
    good = F.col("whole") & (F.col("n_read") == F.col("n_tokens")) & F.coalesce("ok", F.lit(False))
    return both.select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32", "n_chunks", good.alias("verified"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids``: the documents themselves, rebuilt from their
    chunks."""
    cut = F.expr("transform(sequence(0, cast(length(parts) / 32 as int) - 1), k -> struct(k, substring(parts, k * 32 + 1, 32) as address))")
    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.explode(cut).alias("p")).select("doc_id", "start", "p.k", "p.address")
    whole = parts.join(_chunks(spark, path), "address").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "payload"))).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([decode_payload(x["payload"]) for x in row]).astype(np.int64) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return whole.mapInArrow(run, "doc_id long, start long, ids array<long>")


def store_digests(docs: DataFrame, tokenizer: str, **columns: str) -> DataFrame:
    """Writes a store in the shared folder and reads its digests back."""
    path = scratch_path(docs.sparkSession, "store")
    write_store(docs, path, tokenizer, **columns)
    return read_digests(docs.sparkSession, path)
