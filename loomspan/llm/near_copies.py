"""SimHash near-dedup at a Jaccard similarity of shingle sets, none lost.

Fingerprints of the shingle sets are joined by the trie join of ``simhash``;
each pair it proposes is confirmed on the whole sets. No budget of bits that a
trie can prune with holds every pair of similarity 0.8 (they differ in some
ten bits of 64), so whatever the fingerprints leave apart goes through an
exact filter: two sets of similarity t or more share one of the first
n - ceil(t n) + 1 shingles of each, in any order that all texts keep. Texts
are filed under these, the shingles of crowded cells last, and every pair that
a file proposes between two groups is confirmed in the same way, unless
sketches of the sets already show too many shingles that only one has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.components import connected_components
from loomspan.llm.shared import slices, texts_of
from loomspan.llm.simhash import SEED, close_links, forest, gram_hashes, majority
from loomspan.storage import settle

#: Words of a shingle; least similarity, as a fraction; the trie join's bits.
WIDTH, LEAST, BUDGET = 5, (4, 5), 3
#: Cells of the counts that order shingles; they steer cost, never results.
CELLS = 1 << 20
PIECES = 16
#: Files of up to so many texts propose all pairs at once; in larger ones
#: neighbours by size come first, then whatever they leave unconnected.
SMALL = 8
#: Rows of other groups, on either side, that a text meets first in its large
#: files, and how many of them it is held against. A text that joins a group
#: meets that group no more, so few pairs are left for the exact end.
NEAR, FEW = 4, 4
#: Longs of a sketch.
SKETCH = 8
SLAB, CHUNK_BYTES = 500_000, 8 << 20
#: Links that one task may hold; more are joined by rounds over the cluster.
AT_ONCE = 1_000_000


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of runs of ``width`` words."""
    return np.unique(gram_hashes(text, width))


def node_of(grams: np.ndarray) -> int:
    """A signed name that equal sets share."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).astype(np.int64))


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether the sets have the similarity ``least`` or more; empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least[1] >= least[0] * (len(a) + len(b) - both)


def _possible(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Pairs that may be similar if the shingle at these positions is the first they share."""
    most = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return most * (least[0] + least[1]) >= least[0] * (na + nb)


def _proposals(rows: tuple[np.ndarray, ...], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs between roots of the sorted (key, node, n, at, root) rows, and
    the rows of large files."""
    key, node, n, at, root = rows
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(cut, len(key)))
    size = np.repeat(sizes, sizes)
    pairs: list[np.ndarray] = []
    for d in range(1, SMALL):
        i = np.flatnonzero(key[:-d] == key[d:])
        i = i[_possible(n[i], at[i], n[i + d], at[i + d], least) & (root[i] != root[i + d])]
        pairs.append(np.stack((np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])), axis=1))
    found = np.unique(np.concatenate(pairs), axis=0)
    if len(found):
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), none, none], ["key", "a", "b", "n", "at"])
    big = size > SMALL
    if big.any():
        yield pa.RecordBatch.from_arrays([pa.array(key[big]), pa.array(node[big]), pa.nulls(int(big.sum()), pa.int64()), pa.array(n[big]), pa.array(at[big])], ["key", "a", "b", "n", "at"])


def _across(rows: tuple[np.ndarray, ...], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """All possible pairs of the sorted (key, node, n, at, root, sketch) rows between two roots."""
    key, node, n, at, root, *bits = rows
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for lo, hi in zip(cut, cut[1:], strict=False):
        if (root[lo:hi] == root[lo]).all():
            continue
        for i in range(lo, hi - 1):
            far = lo + int(np.searchsorted(n[lo:hi], n[i] * least[1] // least[0], side="right"))
            j = np.arange(i + 1, max(i + 1, far))
            j = j[(root[j] != root[i]) & _possible(n[i], at[i], n[j], at[j], least)]
            j = j[_near(n[i], n[j], [x[i] for x in bits], [x[j] for x in bits], least)]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])


def sketch(grams: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of the set's hashes falls on it."""
    odd = np.bincount(((grams >> np.uint64(20)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(na: np.ndarray, nb: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """Pairs that may be similar by their sketches: a bit that differs takes
    at least one shingle that only one of the sets has."""
    apart = sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in zip(a, b, strict=True))
    return apart * (least[1] + least[0]) <= (na + nb) * (least[1] - least[0])


def _beside(rows: tuple[np.ndarray, ...], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """For rows of the sorted (key, node, n, at, root, sketch) the possible
    pairs with their next rows of another root, on either side by size."""
    key, node, n, at, root, *bits = rows
    cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (root[1:] != root[:-1]))))
    lengths = np.diff(np.append(cut, len(key)))
    after, before = np.repeat(cut + lengths, lengths), np.repeat(cut - 1, lengths)
    for far in range(NEAR):
        for j in (after + far, before - far):
            i = np.flatnonzero((j >= 0) & (j < len(key)))
            j = j[i]
            keep = (key[i] == key[j]) & (root[i] != root[j])
            i, j = i[keep], j[keep]
            keep = _possible(n[i], at[i], n[j], at[j], least) & _near(n[i], n[j], [x[i] for x in bits], [x[j] for x in bits], least)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[i[keep]]), pa.array(node[j[keep]])], ["a", "b"])


def _best(pairs: DataFrame) -> DataFrame:
    """Of the pairs that each text proposes the ones that most files propose."""
    order = Window.partitionBy("a").orderBy(F.col("count").desc(), "b")
    few = pairs.groupBy("a", "b").count().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= FEW)
    return few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_key(work, least: tuple[int, int]):
    """``work`` over runs of whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            count += batch.num_rows
            if count >= SLAB:
                rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
                if cut:
                    yield from work(tuple(c[:cut] for c in rows), least)
                held, count = [tuple(c[cut:] for c in rows)], len(rows[0]) - cut
        if count:
            yield from work(tuple(np.concatenate(c) for c in zip(*held, strict=True)), least)

    return run


def _confirmed(pairs: DataFrame, nodes: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar."""
    side = lambda c, t: nodes.select(F.col("node").alias(c), F.col("text").alias(t))
    both = pairs.join(side("a", "text"), "a").join(side("b", "other"), "b").select("a", "b", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            good = [similar(shingles(x, width), shingles(y, width), least) for x, y in zip(texts_of(batch, "text"), texts_of(batch, "other"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return settle(both.mapInArrow(run, "a long, b long"), "links")


def _reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    return nodes, nodes[forest(len(nodes), at[: len(a)], at[len(a) :])]


def _roots(links: DataFrame) -> DataFrame:
    """``node, root`` as by ``connected_components``. Up to ``AT_ONCE`` links
    are joined in one task: the rounds over a cluster are dozens of stages, and
    the driver keeps a record of each of their tasks."""
    if links.count() > AT_ONCE:
        return connected_components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            nodes, roots = _reached(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return settle(links.where("a != b").select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "roots")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST, budget: int = BUDGET) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (of the shingle set, 16
    hex digits), ``component_id``, the smallest doc_id reachable over pairs of
    Jaccard similarity ``least`` or more.

    Equal sets are one node. Texts without words are alike. A null doc_id takes
    part but names a component only where no other id is in it. Repeated rows
    give repeated rows; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    seen_as = ["doc_id", "uid", "node", "fp", "piece", "cells"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.uint32)
        some = False
        for batch in slices(batches, "text", CHUNK_BYTES):
            names, prints = [], []
            for text in texts_of(batch, "text"):
                grams = shingles(text, width)
                names.append(node_of(grams))
                prints.append(majority(grams))
                np.add.at(cells, (grams % np.uint64(CELLS)).astype(np.int64), 1)
            some = some or batch.num_rows > 0
            m = batch.num_rows
            cols = (batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(cols), seen_as)
        if some:
            none = pa.nulls(PIECES, pa.int64())
            parts = [c.tobytes() for c in np.array_split(cells, PIECES)]
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], seen_as)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[piece] = total.get(piece, 0) + np.frombuffer(cells, dtype=np.uint32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "cells"])

    seen = settle(rows.mapInArrow(read, "doc_id long, uid long, node long, fp long, piece int, cells binary"), "sets")
    parts = seen.where("piece IS NOT NULL").select("piece", "cells").repartition(PIECES, "piece").mapInArrow(add, "piece int, cells binary").collect()
    crowd = np.concatenate([np.frombuffer(r["cells"], dtype=np.int64) for r in sorted(parts, key=lambda r: r["piece"])]) if parts else np.zeros(CELLS, np.int64)
    shared = spark.sparkContext.broadcast(crowd)
    names = seen.where("piece IS NULL").select("doc_id", "uid", "node", "fp")
    firsts = settle(names.groupBy("node", "fp").agg(F.min("uid").alias("_uid"), F.min("doc_id").alias("first_id")), "firsts")
    nodes = rows.join(firsts.select("_uid", "node"), F.col("uid") == F.col("_uid")).dropDuplicates(["uid", "node"]).select("node", "text")
    nodes = settle(nodes, "nodes")

    # the trie join over fingerprints; a crowd of sets with one fingerprint is a star
    prints = firsts.groupBy("fp").agg(F.min("node").alias("one"))
    alike = firsts.join(prints, "fp").where("node != one").select(F.col("one").alias("a"), F.col("node").alias("b"))
    side = lambda c: prints.select(F.col("fp").alias(c), F.col("one").alias(f"_{c}"))
    close = close_links(prints.select("fp"), budget).join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    links = _confirmed(alike.unionByName(close).distinct(), nodes, width, least)
    roots = _roots(links)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = shared.value
        for batch in slices(batches, "text", CHUNK_BYTES):
            keys, sizes, ns = [], [], []
            for text in texts_of(batch, "text"):
                grams = shingles(text, width)
                n = len(grams)
                order = np.lexsort((grams, crowd[(grams % np.uint64(CELLS)).astype(np.int64)]))
                first = grams[order[: n + least[0] * -n // least[1] + 1]] if n else grams
                keys.append(first.view(np.int64))
                sizes.append(len(first))
                ns.append(n)
            sizes = np.array(sizes, dtype=np.int64)
            at = np.concatenate([np.arange(k) for k in sizes.tolist()]).astype(np.int64)
            node, root = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cols = [np.concatenate(keys), np.repeat(node, sizes), np.repeat(np.array(ns, dtype=np.int64), sizes), at, np.repeat(root, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "a", "n", "at", "root"])

    rooted = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "text", F.coalesce("root", "node").alias("root"))
    filed = rooted.mapInArrow(file, "key long, a long, n long, at long, root long").repartition("key").sortWithinPartitions("key", "n", "a")
    proposed = settle(filed.mapInArrow(_by_key(_proposals, least), "key long, a long, b long, n long, at long"), "proposed")
    links = links.unionByName(_confirmed(proposed.where("key IS NULL").select("a", "b").distinct(), nodes, width, least))
    roots = _roots(links)
    crowded = proposed.where("key IS NOT NULL").select("key", "a", "n", "at")
    if crowded.take(1):
        parts = [f"s{i}" for i in range(SKETCH)]

        def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", CHUNK_BYTES):
                found = np.array([sketch(shingles(text, width)) for text in texts_of(batch, "text")]).reshape(-1, SKETCH)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i].copy()) for i in range(SKETCH))], ["node", *parts])

        some = nodes.join(crowded.select(F.col("a").alias("_node")).distinct(), F.col("node") == F.col("_node")).select("node", "text")
        sketches = settle(some.mapInArrow(sketched, ", ".join(f"{c} long" for c in ("node", *parts))), "sketches")

        def across(work) -> DataFrame:
            told = sketches.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"), *parts)
            rooted = crowded.join(told, F.col("a") == F.col("node")).select("key", "a", "n", "at", "root", *parts)
            return rooted.repartition("key").sortWithinPartitions("key", "n", "a").mapInArrow(_by_key(work, least), "a long, b long")

        found = _confirmed(_best(across(_beside)), nodes, width, least)
        if found.take(1):
            links = links.unionByName(found)
            roots = _roots(links)
        found = _confirmed(across(_across).distinct(), nodes, width, least)
        if found.take(1):
            roots = _roots(links.unionByName(found))
    named = firsts.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("node").alias("_node"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return names.join(named, F.col("node") == F.col("_node")).select("doc_id", digits.alias("fingerprint"), "component_id")
