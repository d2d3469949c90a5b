"""SimHash near-duplicates: a self-join of binary tries over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.components import connected_components
from loomspan.llm.shared import slices, texts_of
from loomspan.storage import settle

SEED = 42
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)
#: How often a crowded file is cut again.
LEVELS = 3
#: Distinct fingerprints under one key; beyond, the key is cut further.
MAX_GROUP = 20_000
#: Fingerprints and node pairs that a worker handles at a time.
SLAB, FRONTIER = 100_000, 1_000_000


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes (little-endian)."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def gram_hashes(text: bytes | None, width: int) -> np.ndarray:
    """The hashes of the runs of ``width`` words, repeats included; a shorter
    text is one run, a text without words has none."""
    words = (text or b"").translate(FOLD).split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    lasts = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), lasts.tolist(), strict=True)), dtype="<u8", count=n)


def fingerprint(text: bytes | None, width: int) -> int:
    """The fingerprint of one text; 0 without words."""
    return majority(gram_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 32 << 20):
            bits = np.array([fingerprint(t, width) for t in texts_of(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _close_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in ``fps`` at ``budget`` differing bits or fewer,
    each within one of the sorted ranges: a range is the root of a trie, a
    node the sub-range that shares its leading bits. Node pairs go down
    together and are dropped when their paths differ in too many bits."""
    zero = [np.concatenate(([0], np.cumsum(((fps >> np.uint64(b)) & np.uint64(1)) == 0))) for b in range(64)]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    stack = [(63, starts, ends, starts, ends, np.zeros(len(starts), dtype=np.int64))]
    while stack:
        bit, a0, a1, b0, b1, used = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[s] for x in (a0, a1, b0, b1, used))) for s in (slice(half), slice(half, None))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            left.append(i[near])
            right.append(j[near])
            a0, a1, b0, b1, used = (x[~single] for x in (a0, a1, b0, b1, used))
        if bit < 0 or not len(a0):
            continue
        z = zero[bit]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        own = a0 == b0
        parts = [(a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1)]
        parts.append(tuple(x[~own] for x in (am, a1, b0, bm, used + 1)))
        parts = [tuple(x[keep] for x in p) for p in parts if (keep := (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)).any()]
        if parts:
            stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches."""
    label = np.arange(n)
    while len(a):
        ra, rb = label[a], label[b]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))  # only roots are hooked: no tree loses its parent
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _links(keys: np.ndarray, fps: np.ndarray, budget: int) -> pa.RecordBatch | None:
    """Links of the sorted (key, fingerprint) rows as stars, so that a crowd
    of m close fingerprints gives m - 1 rows."""
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(cut[1:], len(keys))
    many = ends - cut > 1
    if not many.any():
        return None
    a, b = _close_pairs(fps, cut[many], ends[many], budget)
    if not len(a):
        return None
    label = forest(len(fps), a, b)
    out = np.flatnonzero(label != np.arange(len(fps)))
    return pa.RecordBatch.from_arrays([pa.array(fps[out].view(np.int64)), pa.array(fps[label[out]].view(np.int64))], ["a", "b"])


def _pieces(rest: Column, cuts: tuple[int, ...]) -> Column:
    """For each piece of ``rest``: its number, its bits and the bits left."""
    out = []
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        mask = F.lit((1 << (hi - lo)) - 1).cast("long")
        value = F.shiftrightunsigned(rest, lo).bitwiseAND(mask)
        below = rest.bitwiseAND(F.lit((1 << lo) - 1).cast("long"))
        above = F.shiftleft(F.shiftrightunsigned(rest, hi), lo) if hi < 64 else F.lit(0).cast("long")
        out.append(F.struct(F.lit(k).alias("piece"), value.alias("value"), below.bitwiseOR(above).alias("rest")))
    return F.explode(F.array(*out))


def _cuts(bits: int, pieces: int) -> tuple[int, ...]:
    """Bit positions that cut ``bits`` into pieces of about one length."""
    return tuple(bits * k // pieces for k in range(pieces + 1))


def close_links(fps: DataFrame, budget: int = 2, max_group: int = MAX_GROUP) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` that connect
    whatever ``budget`` or fewer differing bits connect.

    Fingerprints that differ in at most that many bits agree in one of
    ``budget`` + 1 pieces. Each is filed under its pieces, that is, the trie is
    built once for each piece with that piece on top, and only node pairs
    without an error on it go on together; every file is a trie that is
    joined with itself. A file of over ``max_group`` fingerprints is cut
    again by pieces of the bits left, and again; after that the bits left
    bound its size.
    """
    if not 0 <= budget <= 7:
        raise ValueError("a budget of 0 to 7 bits: more pieces would be too short to part the fingerprints")
    rows = fps.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    ready: DataFrame | None = None
    bits, pieces = 64, budget + 1
    for level in range(LEVELS):
        cuts = _cuts(bits, pieces)
        bits -= bits // pieces
        split = rows.select("fp", "key", _pieces(F.col("rest"), cuts).alias("p"))
        split = split.select("fp", F.xxhash64("key", F.lit(level), "p.piece", "p.value").alias("key"), "p.rest")
        if level == LEVELS - 1 or not bits:
            done = split
            ready = done.select("key", "fp") if ready is None else ready.unionByName(done.select("key", "fp"))
            break
        crowded = settle(split.groupBy("key").count().where(F.col("count") > max_group).select("key"), "crowded")
        some = bool(crowded.take(1))
        done = (split.join(crowded, "key", "left_anti") if some else split).select("key", "fp")
        ready = done if ready is None else ready.unionByName(done)
        if not some:
            break
        rows = split.join(crowded, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            held_k = np.concatenate((held_k, batch.column(0).to_numpy()))
            held_f = np.concatenate((held_f, batch.column(1).to_numpy().view(np.uint64)))
            if len(held_k) >= SLAB and held_k[0] != held_k[-1]:
                cut = int(np.searchsorted(held_k, held_k[-1]))
                if found := _links(held_k[:cut], held_f[:cut] ^ SIGN, budget):
                    yield found
                held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k) and (found := _links(held_k, held_f ^ SIGN, budget)):
            yield found

    dealt = ready.repartition("key").sortWithinPartitions("key", "fp")
    found = dealt.mapInArrow(run, "a long, b long")
    low = F.lit(-(1 << 63)).cast("long")
    return found.select(F.col("a").bitwiseXOR(low).alias("a"), F.col("b").bitwiseXOR(low).alias("b"))


#: Spark sorts longs as signed; with the top bit flipped the order is that of
#: the unsigned numbers a trie needs.
SIGN = np.uint64(1 << 63)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id``: the smallest doc_id reachable over links.

    Without ``similarity``, links are fingerprints (over all runs of ``width``
    words, repeats included) at ``budget`` or fewer differing bits. With it, a
    fraction, links are texts whose sets of runs have that Jaccard similarity
    or more: pairs within ``budget`` bits are confirmed on the sets and an
    exact filter finds those further apart (see ``near_copies``).

    Copies share a fingerprint and are one node, so groups of copies of any
    size cost nothing in the join. Null, empty and word-less texts have the
    fingerprint 0 and link like any other; a text of fewer than ``width``
    words is one shingle. Repeated rows give repeated rows. A null doc_id
    takes part but names a component only where no other id is in it. An
    empty table gives no rows; other columns are ignored.
    """
    if similarity is not None:
        from loomspan.llm.near_copies import near_copies

        return near_copies(docs, id_col, text_col, width, similarity, budget)
    prints = settle(fingerprints(docs, id_col, text_col, width), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(close_links(classes.select("fp"), budget))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", digits.alias("fingerprint"), "component_id")
