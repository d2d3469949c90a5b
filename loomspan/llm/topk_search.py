"""Exact top-k inner products by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.storage import scratch_path, settle, shuffles_removed

#: Rows of a candidate block and of a query block; dimensions of a step.
CANDIDATES, QUERIES, STEP = 4_096, 256, 16
#: Bytes of query blocks that go to the executors at once, about.
GROUP_BYTES = 16 << 20
#: Whole numbers up to these are exact in the sums of a kind.
EXACT = ((np.float32, float(2**24)), (np.float64, float(2**53)))
NONE = -(2.0**63)
KINDS = {"i2": 2**15, "i4": 2**31}


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Vertical blocks ``name, dim, kind, ids, cells``: each partition's rows
    in the order they come, ``size`` at a time; ``cells`` holds dimension
    after dimension, in the shortest kind of number that holds all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        name = TaskContext.get().partitionId() << 32

        def row(dim: int) -> pa.RecordBatch:
            nonlocal name
            ids, vectors = held.pop(dim)
            cells = np.ascontiguousarray(np.stack(vectors).T)
            top = np.abs(cells).max(initial=0)
            kind = next((k for k, most in KINDS.items() if top < most), "f8")
            values = ([name], [dim], [kind], [np.array(ids, dtype="<i8").tobytes()], [cells.astype(f"<{kind}").tobytes()])
            name += 1
            types = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, types, strict=True)], ["name", "dim", "kind", "ids", "cells"])

        for batch in batches:
            lists = batch.column(1)
            flat = np.floor(64.0 * lists.flatten().to_numpy().astype(np.float64))
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            for i, vec in enumerate(batch.column(0).to_pylist()):
                x = flat[ends[i] : ends[i + 1]]
                ids, vectors = held.setdefault(len(x), ([], []))
                ids.append(vec)
                vectors.append(x)
                if len(ids) == size:
                    yield row(len(x))
        for dim in [*held]:
            yield row(dim)

    return settle(rows.mapInArrow(run, "name long, dim int, kind string, ids binary, cells binary"), "blocks")


def _read(dim: int, kind: str, ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    return ids, np.frombuffer(cells, dtype=f"<{kind}").astype(np.float64).reshape(dim, len(ids))


def search_block(query: np.ndarray, query_ids: np.ndarray, cells: np.ndarray, ids: np.ndarray, k: int, bounds: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of the ``k`` best of one block, those
    left out that score less than its bound.

    ``query`` and ``cells`` are vertical: dims x rows. Inner products grow a
    step of dimensions at a time. What is left of a pair can add or take at
    most the product of the lengths of the remaining parts; candidates that
    can reach neither the bound nor the k-th best sure score are dropped and
    the rest moved together before the next step.
    """
    dims, n = cells.shape
    bounds = np.full(query.shape[1], NONE) if bounds is None else bounds
    top = max(np.abs(query).max(initial=0), 1) * max(np.abs(cells).max(initial=0), 1) * max(dims, 1)
    kind = next((x for x, most in EXACT if top < most), None)
    if kind is None:  # whole numbers too large for floats: exact, and slow
        query, cells = (np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape) for m in (query, cells))
        whole = query.T.dot(cells) if dims else np.zeros((query.shape[1], n), dtype=object)
        for q, own in enumerate(query_ids.tolist()):
            best = sorted((-s, v) for s, v in zip(whole[q].tolist(), ids.tolist(), strict=True) if v != own)[:k]
            if best and max(abs(s) for s, _ in best) >= 2**63:
                raise OverflowError("a score exceeds 64 bits")
            yield np.array([v for _, v in best], dtype=np.int64), np.array([-s for s, _ in best], dtype=np.int64)
        return
    steps = list(range(0, dims, STEP))
    rest_c = [np.sqrt((cells[s + STEP :] ** 2).sum(axis=0)) for s in steps]
    rest_q = [np.sqrt((query[s + STEP :] ** 2).sum(axis=0)) for s in steps]
    cells, query = cells.astype(kind), np.ascontiguousarray(query.T).astype(kind)
    begun = query[:, :STEP] @ cells[:STEP] if dims else np.zeros((len(query), n))
    for q, own in enumerate(query_ids.tolist()):
        alive = np.flatnonzero(ids != own)
        score = begun[q, alive].astype(np.float64)
        for at, s in enumerate(steps):
            if at:
                score = score + query[q, s : s + STEP] @ cells[s : s + STEP, alive]
            # 1e-6: rounding in the bounds; the scores are whole numbers
            sure = bounds[q]
            slack = rest_q[at][q] * rest_c[at][alive]
            if len(alive) > k:
                sure = max(sure, np.partition(score - slack, len(alive) - k)[len(alive) - k])
            keep = score + slack >= sure - 1e-6 * (1 + abs(sure))
            alive, score = alive[keep], score[keep]
        order = np.lexsort((ids[alive], -score))[:k]
        yield ids[alive[order]], score[order].astype(np.int64)


class Best:
    """The best so far of each query of some blocks, ``k`` at most."""

    def __init__(self, asked: list[tuple], k: int, bounds: dict[int, np.ndarray]) -> None:
        self.asked, self.k, self.bounds = asked, k, {a[0]: bounds.get(a[0], np.full(len(a[2]), NONE)).copy() for a in asked}
        self.ids: dict[int, list[np.ndarray]] = {a[0]: [np.empty(0, np.int64)] * len(a[2]) for a in asked}
        self.scores = {name: list(x) for name, x in self.ids.items()}

    def meet(self, dim: int, ids: np.ndarray, cells: np.ndarray) -> None:
        for name, of, query_ids, query in self.asked:
            if of != dim:
                continue
            for q, (found, scores) in enumerate(search_block(query, query_ids, cells, ids, self.k, self.bounds[name])):
                found, scores = np.concatenate((self.ids[name][q], found)), np.concatenate((self.scores[name][q], scores))
                order = np.lexsort((found, -scores))[: self.k]
                self.ids[name][q], self.scores[name][q] = found[order], scores[order]
                if len(order) == self.k:
                    self.bounds[name][q] = max(self.bounds[name][q], float(scores[order[-1]]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for name, _, query_ids, _ in self.asked:
            sizes = np.array([len(x) for x in self.ids[name]])
            nth = np.repeat(np.arange(len(sizes)), sizes)
            if len(nth):
                cols = (np.full(len(nth), name), nth, query_ids[nth], np.concatenate(self.ids[name]), np.concatenate(self.scores[name]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["name", "nth", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` holds
    for, the ``k`` rows of the greatest integer inner product among all rows
    but those of the query's own id; ties go to the smaller id.

    Components are floor(64 * x). Rows whose id or vector is null, or whose
    vector holds a null or non-finite component, take no part; vectors meet
    only vectors of their own length; empty ones score 0. Rows that repeat an
    id are candidates of their own; a repeated query is answered as often as
    it stands. An empty table gives no rows; other columns are ignored.

    Vertical blocks are cut where rows stand, so nothing is shuffled but the
    answers. Query blocks go to the executors in groups of about
    ``GROUP_BYTES``; a group passes over all candidates once, every task keeps
    the ``k`` best of each query over its blocks, and all start from the k-th
    best of one block as the bound.
    """
    spark = vectors.sparkSession
    double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), double.alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"), finite.alias("finite"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.col("finite"))
    held = _blocks(rows.select("vec_id", "embedding"), CANDIDATES)
    asked = _blocks(rows.where("asks").select("vec_id", "embedding"), QUERIES)
    size = asked.agg(F.coalesce(F.sum(F.length("cells") + F.length("ids")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    schema, path = "name long, nth long, query_id long, vec_id long, score long", scratch_path(spark, "best")
    for group in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("name"), F.lit(groups)) == group).collect()
        blocks = [(r["name"], r["dim"], *_read(r["dim"], r["kind"], r["ids"], r["cells"])) for r in mine]
        # one block of each length of vector gives the bounds to start from
        first: dict[int, np.ndarray] = {}
        seeds = held.where(F.col("dim").isin([d for d in {b[1] for b in blocks}])).limit(1).collect() if blocks else []
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, bounds=first) -> Iterator[pa.RecordBatch]:
            best = Best(shared.value, k, bounds)
            for batch in batches:
                for i in range(batch.num_rows):
                    dim, kind, ids, cells = (c[i].as_py() for c in batch.columns)
                    best.meet(dim, *_read(dim, kind, ids, cells))
            yield from best.rows()

        if seeds:
            seed = spark.createDataFrame([tuple(seeds[0])], held.schema)
            found = seed.select("dim", "kind", "ids", "cells").mapInArrow(run, schema).groupBy("name", "nth").agg(F.min("score").alias("low"), F.count("*").alias("n"))
            for r in found.where(F.col("n") == k).collect():
                first.setdefault(r["name"], np.full(next(len(b[2]) for b in blocks if b[0] == r["name"]), NONE))[r["nth"]] = float(r["low"])
        with shuffles_removed(spark):
            held.select("dim", "kind", "ids", "cells").mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("name", "nth").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
