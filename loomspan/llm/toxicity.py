"""Toxicity with a chain of linear classifiers.

Categories are predicted one after the other; each later model also sees the
log-odds of the earlier ones. In training those come from out-of-fold models,
so a later model learns to use what an earlier one says of texts that it
hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.llm.shared import kept_names, slices, texts_of
from loomspan.storage import settle

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MARKS = b".,;:!?\"'()[]{}"
UPPERS, SYMBOLS, DIGITS = bytes(range(65, 91)), b"#*$%&|<>!", b"0123456789"
#: Labelled rows that the chain is fitted on, those of the smallest hashed
#: ids; word and stem features that it may use; texts that a feature needs.
SAMPLE, FEATURES, LEAST = 12_000, 4_000, 4
#: Bytes of a stem; a stem is a feature as its own words vary.
STEMS = (4, 5, 6)
FOLDS, STEPS, RATE, PENALTY = 5, 200, 0.1, 2e-4
CHUNK_BYTES = 8 << 20


def features(text: bytes | None) -> set[bytes]:
    """The distinct words, and their stems with their length before them."""
    words = {w.strip(MARKS) for w in (text or b"").translate(FOLD).split()}
    out = {b"w" + w for w in words if w}
    for n in STEMS:
        mark = b"%d" % n
        out |= {mark + w[:n] for w in words if len(w) >= n}
    return out


def shape(text: bytes | None) -> list[float]:
    """Measures of a text's form, each between 0 and about 1."""
    text = text or b""
    n = max(1, len(text))
    lines = text.split(b"\n")
    words = text.split()
    count = lambda drop: len(text) - len(text.translate(None, drop))
    return [
        count(UPPERS) / n, count(SYMBOLS) / n, count(DIGITS) / n, 1 - len(set(lines)) / len(lines),
        1 - len(set(words)) / max(1, len(words)), min(3.0, n / max(1, len(words)) / 10), np.log1p(len(words)) / 10,
    ]


@dataclass
class Rows:
    """Sparse binary features by row, and dense ones."""

    columns: np.ndarray
    starts: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, lists: list[list[int]], dense: np.ndarray) -> Rows:
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        columns = np.fromiter((c for x in lists for c in x), dtype=np.int64, count=int(sizes.sum()))
        return cls(columns, np.concatenate(([0], np.cumsum(sizes))), dense)

    def take(self, rows: np.ndarray) -> Rows:
        lists = [self.columns[self.starts[i] : self.starts[i + 1]].tolist() for i in rows]
        return Rows.of(lists, self.dense[rows])

    def only(self, allowed: np.ndarray) -> Rows:
        """The rows with the allowed features alone."""
        stay = allowed[self.columns]
        held = np.concatenate(([0], np.cumsum(stay)))
        return Rows(self.columns[stay], held[self.starts], self.dense)

    def dot(self, weights: np.ndarray, dense: np.ndarray, bias: float) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(weights[self.columns])))
        return sums[self.starts[1:]] - sums[self.starts[:-1]] + self.dense @ dense + bias


@dataclass
class Linear:
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: Rows, truth: np.ndarray, n_features: int) -> Linear:
        """Penalised logistic regression by full-batch Adam steps."""
        sizes, n = np.diff(rows.starts), max(1, len(truth))
        of = np.repeat(np.arange(len(truth)), sizes)
        theta = np.zeros(n_features + rows.dense.shape[1] + 1)
        share = np.clip(truth.mean() if len(truth) else 0.5, 1e-3, 1 - 1e-3)
        theta[-1] = np.log(share / (1 - share))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, STEPS + 1):
            z = rows.dot(theta[:n_features], theta[n_features:-1], theta[-1])
            miss = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - truth) / n
            grad = np.concatenate((np.bincount(rows.columns, weights=miss[of], minlength=n_features), rows.dense.T @ miss, [miss.sum()]))
            grad[:-1] += PENALTY * theta[:-1]
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            theta -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        return cls(theta[:n_features], theta[n_features:-1], float(theta[-1]))

    def odds(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights, self.dense, self.bias)


@dataclass
class Chain:
    """``names`` in order; each with its model and its threshold."""

    names: list[str]
    columns: dict[bytes, int]
    mean: np.ndarray
    spread: np.ndarray
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def rows(self, lists: list[list[int]], dense: list[list[float]]) -> Rows:
        return Rows.of(lists, (np.array(dense).reshape(len(lists), -1) - self.mean) / self.spread)

    def predict(self, rows: Rows) -> list[np.ndarray]:
        """The probabilities by category; each model gets the log-odds before
        it as dense features."""
        out, dense = [], rows.dense
        for model in self.models:
            z = np.clip(model.odds(Rows(rows.columns, rows.starts, dense)), -20, 20)
            out.append(1 / (1 + np.exp(-z)))
            dense = np.column_stack((dense, z / 5))
        return out


def best_threshold(odds: np.ndarray, truth: np.ndarray) -> float:
    """The probability, between two rows, at which F1 is greatest."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(odds) + 1) + truth.sum())
    last = np.concatenate((odds[order][1:] != odds[order][:-1], [True]))
    at = int(np.where(last, f1, -1).argmax())
    low = odds[order][at + 1] if at + 1 < len(odds) else odds[order][at] - 1
    return float(1 / (1 + np.exp(-np.clip((odds[order][at] + low) / 2, -20, 20))))


def fit_chain(names: list[str], columns: dict[bytes, int], lists: list[list[int]], dense: list[list[float]], truth: np.ndarray, folds: np.ndarray, allowed: list[np.ndarray]) -> Chain:
    """Fits the chain on the rows; ``truth`` has a column for each name.
    ``allowed`` has the features chosen without each fold, and from all rows
    last: what is out of fold has no part in a fold's model."""
    plain = np.array(dense)
    spread = plain.std(axis=0)
    chain = Chain(names, columns, plain.mean(axis=0), np.where(spread > 1e-9, spread, 1.0))
    rows = chain.rows(lists, dense)
    seen = rows.dense
    for k in range(len(names)):
        now, outside = Rows(rows.columns, rows.starts, seen), np.zeros(len(lists))
        for f in range(FOLDS):
            test, fit = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            outside[test] = Linear.fit(now.take(fit).only(allowed[f]), truth[fit, k], len(columns)).odds(now.take(test))
        chain.models.append(Linear.fit(now.only(allowed[FOLDS]), truth[:, k], len(columns)))
        chain.thresholds.append(best_threshold(outside, truth[:, k]))
        seen = np.column_stack((seen, np.clip(outside, -20, 20) / 5))
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """A chain over ``categories`` (name: 0/1 expression over ``labels``, in
    order), or None where a category has no example for or against.

    An id labelled more than once counts where any of its labels says so; one
    that several documents bear stands for the text of the smallest hash.
    Null labels count as 0. The sample is of ``SAMPLE`` labelled ids at most;
    the features are those of its texts that tell the categories apart best,
    chosen without each fold for that fold's out-of-fold model.
    """
    names = list(categories)
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
    marked = marked.agg(*[F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in categories.items()])
    chosen = marked.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_id", F.array(*names).alias("truth"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    # SAMPLE rows of whole numbers: small enough to broadcast at any size
    sample = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "truth").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    fold = F.pmod(F.shiftrightunsigned(F.col("_id") * F.lit(2654435761), 7), F.lit(FOLDS)).cast("int")
    sample = settle(sample.select("_id", "truth", fold.alias("fold"), F.col("one.text").alias("text")), "sample")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            found = [list(features(t)) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.binary()))], ["truth", "fold", "found"])

    told = sample.mapInArrow(tell, "truth array<int>, fold int, found array<binary>").select("truth", "fold", F.explode("found").alias("x"))

    def by_fold(value: Column) -> list[Column]:
        return [F.coalesce(F.sum(F.when(F.col("fold") == f, value)), F.lit(0)).cast("double") for f in range(FOLDS)]

    def totals() -> list[Column]:
        """Rows, and rows for each category, in each fold."""
        return [F.array(*by_fold(v)).alias(n) for n, v in (("n", F.lit(1)), *((f"n{k}", F.col("truth")[k]) for k in range(len(names))))]

    whole = sample.agg(*totals()).first()
    if any(not 0 < sum(whole[f"n{k}"]) < sum(whole["n"]) for k in range(len(names))):
        return None
    sums = told.groupBy("x").agg(*totals())
    told_apart = []
    for f in range(FOLDS + 1):
        without = lambda c, f=f: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) - (F.col(c)[f] if f < FOLDS else 0.0)
        n, total = without("n"), sum(whole["n"]) - (whole["n"][f] if f < FOLDS else 0.0)
        for k in range(len(names)):
            yes = sum(whole[f"n{k}"]) - (whole[f"n{k}"][f] if f < FOLDS else 0.0)
            a = without(f"n{k}")
            b, c = n - a, yes - a
            chi = total * F.pow(a * (total - yes - b) - b * c, 2) / (n * (total - n + 1e-9) * (yes * (total - yes) + 1e-9))
            told_apart.append(F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), F.when(n >= LEAST, chi).alias("chi")))
    ranked = sums.select("x", F.explode(F.array(*told_apart)).alias("t")).select("x", "t.*").where("chi IS NOT NULL")
    best = Window.partitionBy("f", "k").orderBy(F.col("chi").desc(), "x")
    picks = ranked.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= FEATURES // len(names)).select("f", F.col("x")).collect()
    picked = {x: i for i, x in enumerate(sorted({bytes(r["x"]) for r in picks}))}
    allowed = [np.zeros(len(picked), dtype=bool) for _ in range(FOLDS + 1)]
    for r in picks:
        allowed[r["f"]][picked[bytes(r["x"])]] = True

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = texts_of(batch, "text")
            found = [sorted(picked[x] for x in features(t) & picked.keys()) for t in texts]
            cols = (batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32())), pa.array([shape(t) for t in texts], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(list(cols), ["_id", "truth", "fold", "found", "shape"])

    data = sample.mapInArrow(gather, "_id long, truth array<int>, fold int, found array<int>, shape array<double>").collect()
    data.sort(key=lambda r: r["_id"])
    truth, folds = np.array([r["truth"] for r in data], dtype=float), np.array([r["fold"] for r in data])
    return fit_chain(names, picked, [r["found"] for r in data], [r["shape"] for r in data], truth, folds, allowed)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, ``p_<category>`` for each category,
    ``toxic`` (the last category's probability reaches its threshold, the one
    of the best out-of-fold F1), ``kept`` (not toxic), and the columns
    ``keep``, unchanged; one of a name above comes back with ``_in`` after it.

    Null, empty and word-less texts are never toxic. Very long texts are read
    whole. Repeated rows give repeated rows; a null doc_id is kept as it is
    and never a training row. Without examples for and against each category
    all probabilities are 0 and all rows are kept. An empty table gives no
    rows; other columns are ignored.
    """
    chain = learn(docs, labels, categories, id_col, text_col)
    names = [f"p_{n}" for n in categories]
    own = ["doc_id", *names, "toxic", "kept"]
    named = kept_names(keep, own)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", CHUNK_BYTES):
            texts = texts_of(batch, "text")
            if model is None:
                chances = [np.zeros(len(texts)) for _ in names]
                toxic = np.zeros(len(texts), dtype=bool)
            else:
                columns = model.columns
                lists = [[columns[x] for x in features(t) & columns.keys()] for t in texts]
                chances = model.predict(model.rows(lists, [shape(t) for t in texts]))
                toxic = (chances[-1] >= model.thresholds[-1]) & np.array([bool(t and t.split(None, 1)) for t in texts])
            cols = [batch.column(0), *map(pa.array, (*chances, toxic, ~toxic))]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[2:]], [*own, *named])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    schema = StructType.fromDDL(f"doc_id long, {', '.join(f'`{n}` double' for n in names)}, toxic boolean, kept boolean")
    for c, n in zip(keep, named, strict=True):
        schema = schema.add(n, docs.schema[c].dataType)
    return rows.mapInArrow(run, schema)
