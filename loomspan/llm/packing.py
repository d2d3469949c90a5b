"""Best-fit packing by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so a histogram of at most
``capacity`` counts holds all that the plan needs, whatever the number of
documents. The plan is made on the histogram: large lengths are rounded up
within groups of equal cardinality, configurations of the few sizes are
optimised as a linear programme by column generation, actual lengths are
substituted for rounded ones, and small lengths are put best-fit. It comes
out as runs of like sequences; each piece then finds its place by its length
and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import slices, texts_of
from loomspan.llm.tokens import encoder
from loomspan.storage import settle

END_ID = 0
#: Numbers of equal-cardinality groups of large lengths that are tried, and the
#: share of the capacity above which a length is large.
GROUPS, LARGE = (24, 48, 96, 192), 0.1
#: Pieces that share a bucket when ranks are given out.
BUCKET_ROWS = 50_000


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, spaced: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each row's ids with the
    end id, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer, spaced)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches, "text", 8 << 20):
            rows: list[list[int | None]] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), codec.encode(texts_of(batch, "text")), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for out, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def group_sizes(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, int]]:
    """(rounded size, number) of the equal-cardinality groups of the lengths
    from ``least`` up, the largest first."""
    lengths = np.flatnonzero(counts[least:]) + least
    total = int(counts[least:].sum())
    share, out, held = -(-total // groups) if total else 1, [], 0
    top = 0
    for n in lengths[::-1].tolist():
        left = int(counts[n])
        while left:
            top = top or n
            take = min(left, share - held)
            held, left = held + take, left - take
            if held == share:
                out.append((top, held))
                held, top = 0, 0
    if held:
        out.append((top, held))
    merged: dict[int, int] = defaultdict(int)
    for size, number in out:
        merged[size] += number
    return sorted(merged.items(), reverse=True)


def _best_column(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest price that fits (a knapsack)."""
    order = np.array(sizes)[::-1]
    gain = price[::-1]
    worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth[room] = worth[room - 1]
        fits = int(np.searchsorted(order, room, side="right"))
        if fits:
            got = worth[room - order[:fits]] + gain[:fits]
            i = int(got.argmax())
            if got[i] > worth[room] + 1e-12:
                worth[room], pick[room] = got[i], len(sizes) - 1 - i
    use, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            use[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(worth[capacity]), use


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """(times, numbers of each size): the linear programme's solution, rounded
    down; what it leaves is for the caller."""
    m = len(sizes)
    if not m:
        return []
    columns = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    inverse = np.diag(1 / np.diag(columns))
    level = inverse @ need
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        value, column = _best_column(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        inverse = np.linalg.inv(columns)
        level = np.maximum(inverse @ need, 0)
    return [(int(t + 1e-9), columns[:, j].astype(int)) for j, t in enumerate(level) if t + 1e-9 >= 1]


Run = tuple[int, list[tuple[int, int]]]


def best_plan(counts: np.ndarray, capacity: int, groups: tuple[int, ...] = GROUPS, large: float = LARGE) -> list[Run]:
    """The plan of fewest sequences over several numbers of groups; a plan is
    made on the histogram alone, so trying some costs the same at any size."""
    return min((plan(counts, capacity, g, large) for g in groups), key=lambda runs: sum(times for times, _ in runs))


def plan(counts: np.ndarray, capacity: int, groups: int, large: float = LARGE) -> list[Run]:
    """Runs of like sequences: (number of sequences, [(length, times)]). Every
    length is used exactly ``counts[length]`` times."""
    counts = counts.astype(np.int64).copy()
    runs: list[Run] = []
    if counts[capacity]:
        runs.append((int(counts[capacity]), [(capacity, 1)]))
        counts[capacity] = 0
    least = max(1, int(capacity * large))
    grouped = group_sizes(counts, least, groups)
    sizes, demand = [s for s, _ in grouped], [n for _, n in grouped]
    # Actual lengths by group, the longest first: the lists that are substituted.
    stock: list[list[list[int]]] = []
    left = counts.copy()
    for k, (_, number) in enumerate(grouped):
        mine = []
        for n in range(sizes[k], least - 1, -1):
            take = min(int(left[n]), number)
            if take:
                mine.append([n, take])
                left[n] -= take
                number -= take
            if not number:
                break
        stock.append(mine[::-1])
    open_: list[Run] = []
    for times, use in configurations(sizes, demand, capacity):
        while times > 0:
            chosen: list[tuple[int, int]] = []
            span = times
            for g in np.flatnonzero(use).tolist():
                n, have = stock[g][-1] if stock[g] else (0, 0)
                k = int(use[g])
                if have >= k:
                    span = min(span, have // k)
                    chosen.append((n, k))
                else:  # the last few of a length go together with the next
                    span = min(span, 1)
                    chosen += _draw([list(x) for x in stock[g]], k)
            for g in np.flatnonzero(use).tolist():
                _draw(stock[g], int(use[g]) * span)
            if chosen:
                open_.append((span, chosen))
            times -= span
    rest: dict[int, int] = defaultdict(int)
    for mine in stock:
        for n, k in mine:
            rest[n] += k
    for n in np.flatnonzero(counts[:least]).tolist():
        rest[n] += int(counts[n])
    return runs + best_fit(open_, rest, capacity)


def _draw(mine: list[list[int]], k: int) -> list[tuple[int, int]]:
    """Takes ``k`` lengths off the end of a stock, or all it has."""
    out = []
    while k and mine:
        take = min(k, mine[-1][1])
        out.append((mine[-1][0], take))
        mine[-1][1] -= take
        k -= take
        if not mine[-1][1]:
            mine.pop()
    return out


def best_fit(open_: list[Run], rest: dict[int, int], capacity: int) -> list[Run]:
    """Puts the lengths of ``rest``, the longest first, each into the fullest
    sequence that holds it, else into a new one; like sequences move together."""
    rooms: dict[int, list[Run]] = defaultdict(list)
    keys: list[int] = []

    def put(room: int, run: Run) -> None:
        if room not in rooms:
            insort(keys, room)
        rooms[room].append(run)

    for times, use in open_:
        put(capacity - sum(n * k for n, k in use), (times, use))
    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            at = bisect_left(keys, n)
            if at == len(keys):
                k = capacity // n
                times = left // k or 1
                k = min(k, left)
                put(capacity - k * n, (times, [(n, k)]))
                left -= times * k
                continue
            room = keys[at]
            times, use = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(at)
            k = min(room // n, left)
            now = min(times, left // k)
            put(room - k * n, (now, [*use, (n, k)]))
            left -= now * k
            if times > now:
                put(room, (times - now, use))
    return [run for room in keys for run in rooms[room]]


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each length and rank among its pieces, where it goes: rows sorted
    by (length, first rank)."""
    rows, given, base = [], defaultdict(int), 0
    for times, use in runs:
        offset = 0
        for n, k in use:
            rows.append((n, given[n], base, offset, k))
            given[n] += times * k
            offset += n * k
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "offset", "each"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, groups: tuple[int, ...] = GROUPS, spaced: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one
    row per piece, gapless from 0 in each sequence.

    Only histograms reach the driver (``capacity`` counts). Null text is
    empty: a piece of the end id alone. Very long texts are whole pieces of
    ``capacity`` and a rest. Repeated rows are packed as often as they occur;
    a null doc_id is kept. An empty table gives no rows; other columns are
    ignored. Ties among pieces of one length go by bucket, doc_id and piece.
    """
    spark = docs.sparkSession
    pieces = settle(cut_pieces(docs, tokenizer, id_col, text_col, capacity, spaced), "pieces")
    buckets = max(1, -(-pieces.count() // BUCKET_ROWS))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    held = settle(pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "held")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in held.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    table = places(best_plan(counts, capacity, groups))
    shared, most = spark.sparkContext.broadcast(table), int(counts.max()) + 1
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_row", F.row_number().over(inside) - 1)
    ranked = ranked.join(held, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_row")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t["length"] * most + t["first"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * most + rank, side="right") - 1
            past = rank - t["first"][at]
            each = t["each"][at]
            where = [t["base"][at] + past // each, t["offset"][at] + past % each * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, where)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
